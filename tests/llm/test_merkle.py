"""The manifest against a plain version of its definition."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from threadwise.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = "crc32(CAST(doc_id AS STRING)) % 3 = 0"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [text if name == "text" else getattr(row, name) for name in FIELDS]
    return sha(
        "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
    )


def climb(nodes):
    """(top, path of each node as (left, right) texts)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, place in zip(paths, at):
            start = place - place % 8
            path.append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0] if nodes else None, paths


def plain(rows, tampering=True):
    groups = defaultdict(list)
    for row in rows:
        text = row.text
        if tampering and row.doc_id is not None and text is not None:
            if zlib.crc32(str(row.doc_id).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[row.lang].append((row.doc_id, leaf(row, row.text), leaf(row, text)))
    names = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    done = {}
    for name in names:
        groups[name].sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
        done[name] = climb([digest for _, digest, _ in groups[name]])
    root, above = climb([done[name][0] for name in names])
    result = Counter()
    for name, path in zip(names, above):
        for (doc_id, digest, found), own in zip(groups[name], done[name][1]):
            folded = found
            for left, right in own + path:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in own + path))
            result[doc_id, digest, done[name][0], root, proof, folded, folded == root] += 1
    return result


def found(docs, **options):
    return Counter(tuple(row) for row in merkle.with_proofs(docs, **options).collect())


def test_awkward_rows(awkward):
    assert found(awkward, tampered=TAMPERED) == plain(awkward.collect())


def test_clashing_names(clashing, awkward):
    extra = clashing.selectExpr("*", "1 AS grp", "2 AS node", "3 AS leaf", "4 AS position")
    assert found(extra, tampered=TAMPERED) == plain(awkward.collect())


def test_empty_table(nothing):
    result = merkle.with_proofs(nothing)
    assert result.columns == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    ]
    assert result.count() == 0


@pytest.mark.parametrize("count", [1, 2, 8, 9, 64, 65, 513, 4096, 4097])
def test_sizes(spark, count):
    """One group around the sizes at which a storey is added, beside a group of one."""
    docs = spark.range(count).selectExpr(
        "id AS doc_id", "'a' AS source", "IF(id = 0, NULL, 'en') AS lang", "id AS n_chars",
        "concat('Text ', id % 5) AS text",
    )
    assert found(docs, tampered=TAMPERED) == plain(docs.collect())


@pytest.mark.parametrize("langs", [1, 9, 70])
def test_small_superblocks(spark, langs, monkeypatch):
    """Several storeys of superblocks, in the groups and above them."""
    monkeypatch.setattr(merkle, "STOREYS", 1)
    monkeypatch.setattr(merkle, "SUPERBLOCK", merkle.RUN)
    docs = spark.range(700).selectExpr(
        "id DIV 2 AS doc_id", "NULL AS source", f"concat('l', id * id % {langs}) AS lang",
        "NULL AS n_chars", "concat('Text ', id) AS text",
    )
    assert found(docs, tampered=TAMPERED) == plain(docs.collect())


def test_untouched_rows_verify_and_changed_ones_do_not(awkward):
    assert merkle.with_proofs(awkward).filter("NOT verified").count() == 0
    rows = merkle.with_proofs(awkward, tampered="doc_id = 7").filter("NOT verified")
    assert [row.doc_id for row in rows.collect()] == [7]


def test_large_and_missing_ids_keep_their_digits(spark):
    ids = [(None,), (2**62 + 1,), (2**62 + 3,)]
    docs = spark.createDataFrame(ids, "doc_id long").selectExpr(
        "doc_id", "'s' AS source", "'l' AS lang", "1L AS n_chars", "'T' AS text"
    )
    assert {row.doc_id for row in merkle.with_proofs(docs).collect()} == {None, 2**62 + 1, 2**62 + 3}
