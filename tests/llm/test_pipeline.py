"""The pipeline against plain functions, and every stage over awkward documents."""

from collections import Counter
from pathlib import Path

import brute
import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row

from threadwise.llm import line_quality, pii

TESTDATA = Path("/root/testdata/sf0.001")


def without(row, above):
    """The row without the lines that are above the limits."""
    lines = [
        line
        for line in (row.text or "").split("\n")
        if not brute.words(line) or (row.source, brute.line_key(line)) not in above
    ]
    return Row(**(row.asDict() | {"text": row.text and "\n".join(lines)}))


def plain_run(rows):
    """(doc id, lang, source, ids) of the documents that remain, by the operators' definitions."""
    texts = [(r.source, r.text) for r in rows]
    above = brute.frequent(texts, line_quality.MIN_DOCUMENTS)
    found = brute.verdicts(texts, line_quality.MIN_DOCUMENTS)
    rows = [without(r, above) for r, (_, _, kept) in zip(rows, found) if kept]
    prints = [(r.doc_id, brute.fingerprint(r.text)) for r in rows]
    chosen = {}
    for row, component in zip(rows, brute.component_ids(prints)):
        if row.doc_id == component:
            chosen.setdefault(component, row)
    rows = [(r.doc_id, r.lang, r.source, pii.mask(r.text)) for r in chosen.values()]
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    result = Counter()
    for row, (size, _, _, taken) in zip(rows, brute.mix([(r[0], r[2], r[3]) for r in rows])):
        if taken:
            result[(*row[:3], tuple(library.encode(row[3])))] += taken // size
    return result


@pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are absent")
def test_equals_plain_run(spark):
    rows = spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()
    found = corpus_pipeline.run(spark, str(TESTDATA)).collect()
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in found) == plain_run(rows)
    assert all(r.n_tokens == len(r.ids) for r in found)


def test_stages_keep_the_columns(spark, clashing, nothing, tmp_path):
    for docs in (clashing, nothing):
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            result = stage(spark, docs, "")
            if number < len(corpus_pipeline.STAGES) - 1:
                assert result.columns == docs.columns, name
            result.write.mode("overwrite").parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
        assert "ids" in docs.columns


def without_frequent_lines(rows):
    """(doc id, text, n_chars) of the documents kept, by plain counts of their lines."""
    texts = [(r.source, r.text) for r in rows]
    above = brute.frequent(texts, line_quality.MIN_DOCUMENTS)
    found = brute.verdicts(texts, line_quality.MIN_DOCUMENTS)
    result = Counter()
    for row, (_, gone, kept) in zip(rows, found):
        clean = without(row, above).text
        if kept:
            result[row.doc_id, clean, len(clean) if gone else row.n_chars] += 1
    return result


def test_frequent_lines_do_not_go_on(spark):
    def prose(name, start, count):
        """Words of letters only: digits don't tell lines apart."""
        places = range(start, start + count)
        return " ".join(f"{name}{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}" for n in places)

    rows = []
    for i in range(80):
        first = prose("a", 7 * i, 40 if i % 4 else 4)
        second = prose("b", 7 * i, 30 if i % 4 else 3)
        text = f"{first}\n\nShared  Line {i % 10}\n{second}\n{prose('c', 0, 60)}\n{i}"
        rows.append((i, text, "en", "h", 7))
    rows.append((99, prose("d", 0, 80), "en", "other", 7))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    want = without_frequent_lines(docs.collect())
    assert len(want) == 61 and not any("Shared" in text for _, text, _ in want)
    assert all("\n\n" in text for doc_id, text, _ in want if doc_id < 80)
    found = corpus_pipeline.quality_rules(spark, docs, "")
    assert found.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in found.collect()) == want
