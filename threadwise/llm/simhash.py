"""SimHash near-duplicates: fingerprints, a binary trie joined with itself, and components.

A text's words are put in shingles, every shingle is hashed to 64 bits, and a fingerprint bit is
set when more than half of the hashes set it. Distinct fingerprints are the leaves of binary tries.
The join walks pairs of trie nodes together, adds up the bits in which their branches differ, and
leaves a pair as soon as the errors exceed what the depth allows.

Cut into ``errors + 1`` blocks, a fingerprint and its neighbour differ in at most ``errors`` bits,
so among the rotations of the blocks there is one whose first j blocks together hold at most
``j * errors / (errors + 1)`` errors, for every j. The trie is built for every rotation: its first
block must agree exactly, which spreads the join over tasks, and the later budgets prune it early.

Defined results: null text is the empty text; a text without words has fingerprint zero and is
linked like any other; fewer words than a shingle are one shingle; exact copies share a
fingerprint and are joined once; a component whose ids are all null has a null id; an empty table
gives an empty table. Input columns named like a column the operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import drop_columns, set_aside, whole_text
from threadwise.session import cut_lineage

SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
BITS = 64
# Fingerprints that one task aims to join; a group may hold more when their first block agrees.
GROUP_ROWS = 50_000
# Node pairs walked at once, and leaf pairs that are compared without walking further.
CHUNK = 200_000
SMALL = 16

ADDED = ("fingerprint", "component_root", "component_id", "simhash_row", "simhash_id")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = list(accumulate(len(word) + 1 for word in words))
        starts = [0, *ends]
        hashes = [
            digest(joined[start : end - 1], seed) for start, end in zip(starts, ends[shingle - 1 :])
        ]
    octets = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    votes = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(octets), 65_536):  # bounded memory for very long texts
        part = np.unpackbits(octets[start : start + 65_536], axis=1, bitorder="little")
        votes += part.sum(axis=0, dtype=np.int64)
    packed = np.packbits(votes * 2 > len(octets), bitorder="little")
    return int(packed.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Add ``fingerprint``."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(text, shingle) for text in texts], dtype="int64")

    return drop_columns(docs, *ADDED).withColumn("fingerprint", fingerprints(whole_text(text)))


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- the trie self-join ------------------------------------------------------------------------


def blocks(errors: int) -> list[tuple[int, int]]:
    """(start, width) of errors + 1 blocks that cover the bits from the highest down."""
    width, longer = divmod(BITS, errors + 1)
    widths = [width + (i < longer) for i in range(errors + 1)]
    return list(zip(accumulate([0, *widths[:-1]]), widths))


def budgets(errors: int, rotation: int) -> list[int]:
    """Errors allowed among the first d bits, for d from 0 to 64, when a rotation comes first."""
    widths = [width for _, width in blocks(errors)]
    widths = widths[rotation:] + widths[:rotation]
    allowed = [0]
    for number, width in enumerate(widths, 1):
        allowed += [number * errors // (errors + 1)] * width
    return allowed


class Forest:
    """Which leaves are already linked, as one label per leaf."""

    def __init__(self, size: int):
        self.labels = np.arange(size)
        self._count_changes()

    def _count_changes(self) -> None:
        steps = np.concatenate([[0], self.labels[1:] != self.labels[:-1]])
        self.changes = np.cumsum(steps)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        labels = self.labels
        while True:
            low = np.minimum(labels[left], labels[right])
            if (labels[left] == low).all() and (labels[right] == low).all():
                break
            for side in (left, right):
                np.minimum.at(labels, labels[side], low)
                np.minimum.at(labels, side, low)
            while (labels[labels] != labels).any():
                labels[:] = labels[labels]
        self._count_changes()

    def joined(self, a, a_end, b, b_end) -> np.ndarray:
        """Node pairs all of whose leaves are linked already."""
        return (
            (self.changes[a_end - 1] == self.changes[a])
            & (self.changes[b_end - 1] == self.changes[b])
            & (self.labels[a] == self.labels[b])
        )


def trie_links(leaves: np.ndarray, first_bits: int, allowed: list[int], errors: int) -> np.ndarray:
    """A label per leaf of a sorted array of distinct fingerprints; linked leaves share it.

    A node at depth d is the range of leaves that agree in their first d bits, so its children meet
    where bit d turns from 0 to 1. Pairs within one component need no further walk.
    """
    forest = Forest(len(leaves))
    if len(leaves) < 2:
        return forest.labels
    heads = leaves >> np.uint64(BITS - first_bits)
    starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    ends = np.append(starts[1:], len(leaves))
    ones: dict[int, np.ndarray] = {}
    stack = [(first_bits, np.stack([starts, ends, starts, ends, np.zeros_like(starts)]))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > CHUNK:
            stack += [(depth, pairs[:, CHUNK:])]
            pairs = pairs[:, :CHUNK]
        a, a_end, b, b_end, differ = pairs
        same = a == b
        open_ = ~((same & (a_end - a == 1)) | forest.joined(a, a_end, b, b_end))
        pairs, same = pairs[:, open_], same[open_]
        a, a_end, b, b_end, differ = pairs
        small = ((a_end - a) * (b_end - b) <= SMALL) | (depth == BITS)
        for left, right in _leaf_pairs(pairs[:, small]):
            near = np.bitwise_count(leaves[left] ^ leaves[right]) <= errors
            if near.any():
                forest.link(left[near], right[near])
        pairs, same = pairs[:, ~small], same[~small]
        if not pairs.shape[1]:
            continue
        if depth not in ones:
            bit = (leaves >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        a, a_end, b, b_end, differ = pairs
        a_mid = a_end - (ones[depth][a_end] - ones[depth][a])
        b_mid = b_end - (ones[depth][b_end] - ones[depth][b])
        children = np.concatenate(
            [
                np.stack([a, a_mid, b, b_mid, differ]),
                np.stack([a_mid, a_end, b_mid, b_end, differ]),
                np.stack([a, a_mid, b_mid, b_end, differ + 1]),
                np.stack([a_mid, a_end, b, b_mid, differ + 1])[:, ~same],
            ],
            axis=1,
        )
        keep = (
            (children[0] < children[1])
            & (children[2] < children[3])
            & (children[4] <= allowed[depth + 1])
        )
        if keep.any():
            stack.append((depth + 1, children[:, keep]))
    return forest.labels


def _leaf_pairs(pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All leaves of the left node with all of the right one, a chunk of node pairs at a time."""
    for start in range(0, pairs.shape[1], CHUNK // SMALL):
        a, a_end, b, b_end, _ = pairs[:, start : start + CHUNK // SMALL]
        width = b_end - b
        count = (a_end - a) * width
        node = np.repeat(np.arange(len(a)), count)
        offset = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
        left, right = a[node] + offset // width[node], b[node] + offset % width[node]
        yield left[left < right], right[left < right]


def _rotate(values: np.ndarray, by: int) -> np.ndarray:
    by %= BITS
    if not by:
        return values
    return (values << np.uint64(by)) | (values >> np.uint64(BITS - by))


def links(distinct: DataFrame, errors: int = MAX_DISTANCE) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints at ``errors`` or fewer differing bits.

    ``distinct`` holds each ``fingerprint`` once. A task returns at most one link per leaf, to the
    smallest leaf it is connected with, so a crowd of near copies does not become all its pairs.
    """
    if not 0 <= errors < BITS:
        raise ValueError("errors must be between 0 and 63")
    parts = blocks(errors)
    rows = distinct.count()
    head_bits = max(1, min(min(w for _, w in parts), (rows // GROUP_ROWS).bit_length()))
    value = F.col("fingerprint")
    rotations = F.array(
        *[
            F.struct(
                F.lit(number).alias("rotation"),
                (
                    F.shiftleft(value, start).bitwiseOR(F.shiftrightunsigned(value, BITS - start))
                    if start
                    else value
                ).alias("leaf"),
            )
            for number, (start, _) in enumerate(parts)
        ]
    )
    rotated = distinct.select(F.inline(rotations)).withColumn(
        "head", F.shiftrightunsigned("leaf", BITS - head_bits)
    )

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rotation = int(group["rotation"].iloc[0])
        leaves = np.sort(group["leaf"].to_numpy(dtype=np.int64).view(np.uint64))
        labels = trie_links(leaves, parts[rotation][1], budgets(errors, rotation), errors)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        back = _rotate(leaves, BITS - parts[rotation][0]).view(np.int64)
        return pd.DataFrame({"a": back[linked], "b": back[labels[linked]]})

    return rotated.groupBy("rotation", "head").applyInPandas(join, "a long, b long")


# --- components --------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node with an edge; the root is the component's smallest node.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    smallest one, then its smaller neighbours and itself. The number of rounds grows with the
    logarithm of the longest path; each round is written, so a lost executor repeats one round.
    """

    def write(df: DataFrame) -> tuple[DataFrame, tuple]:
        table = cut_lineage(df.distinct())
        state = table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return table, tuple(state)

    current, state = write(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.join(lowest, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        large = cut_lineage(large.distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(
            F.inline(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                    F.struct(F.col("a").alias("a"), F.col("low").alias("b")),
                )
            )
        )
        previous = state
        current, state = write(small.filter("a <> b"))
        if state == previous:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    fingerprinted: DataFrame, doc_id: str = "doc_id", errors: int = MAX_DISTANCE
) -> DataFrame:
    """Add ``component_root`` (a fingerprint) and ``component_id`` (its smallest document id).

    ``fingerprinted`` is read twice, so hand over a table and not a long computation.
    """
    fingerprinted = drop_columns(fingerprinted, "component_root", "component_id")
    nodes = cut_lineage(
        fingerprinted.groupBy("fingerprint").agg(F.min(doc_id).alias("smallest"))
    )
    roots = components(links(nodes.select("fingerprint"), errors))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint",
        F.coalesce("root", "fingerprint").alias("component_root"),
        "smallest",
    )
    rooted = cut_lineage(rooted)
    # Both sides of the join are written tables, so a component of any size can be split in it.
    ids = cut_lineage(
        rooted.groupBy("component_root").agg(F.min("smallest").alias("component_id"))
    )
    labels = rooted.drop("smallest").join(ids, "component_root")
    return fingerprinted.join(labels, "fingerprint")


def deduplicated(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    errors: int = MAX_DISTANCE,
) -> DataFrame:
    """One document of each component: the one with the smallest id, with the input's columns.

    Texts are read and fingerprinted once and written with a row number. The decision is made on
    numbers, ids and fingerprints alone, and only the numbers of the rows that go come back.
    """
    inputs, restored = set_aside(docs, ADDED)
    stored = cut_lineage(
        with_fingerprint(inputs, text, shingle).withColumn(
            "simhash_row", F.monotonically_increasing_id()
        )
    )
    labelled = near_duplicates(
        stored.select("simhash_row", F.col(doc_id).alias("simhash_id"), "fingerprint"),
        "simhash_id",
        errors,
    )
    labelled = cut_lineage(
        labelled.select(
            "simhash_row",
            "component_root",
            F.col("simhash_id").eqNullSafe(F.col("component_id")).alias("smallest"),
        )
    )
    first = (
        labelled.filter("smallest").groupBy("component_root")
        .agg(F.min("simhash_row").alias("simhash_row"))
    )
    others = cut_lineage(
        labelled.select("simhash_row").join(first, "simhash_row", "left_anti")
    )
    return stored.join(others, "simhash_row", "left_anti").select(*restored)
