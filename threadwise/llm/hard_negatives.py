"""Hard negatives for contrastive training, from exact integer inner products.

Vectors are quantised to integers, ``floor(256 x)``. For every anchor the nearest other rows of its
label are its positives; for every positive the hard negatives are the nearest rows of other labels
that score close below it. Scores come from tiles of anchors and candidates that are multiplied by
Strassen's recursion on 64-bit integers, odd sides padded with zeros. Integers make its sums and
differences exact, whatever their order.

Two passes, each a block product over Spark: anchors and candidates are dealt to blocks, and each
pair of blocks is one group of a cogroup.

1. Positives: blocks within one label, so the pass costs a label's share of all pairs. Each pair of
   blocks keeps a bounded heap per anchor.
2. Windows: blocks over all candidates. Each pair of blocks keeps a bounded heap per anchor and
   positive, of the candidates inside the positive's window.

Heaps hold the few best by (score descending, id ascending), so merging the heaps of all blocks
gives the best of all rows: a ranking per anchor that Spark cuts before and after its shuffle.
Vectors travel as integers of the least width that holds them, tiles keep a task's memory bounded,
and a label with any share of the rows is dealt over as many blocks as its size asks for.

Defined results: rows with a null label, a null vector or a null or non-finite component take no
part; rows without id are candidates and come last among ties, but no anchors; empty vectors score
0; only vectors of the same length are compared; rows with the same id are rows of their own, so a
repeated anchor is mined once for each of its rows; anchors without a positive, and positives with
an empty window, give no rows; an empty table gives an empty table; other columns take no part. A
vector so long that products of 2^60 could arise is refused, since scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# The window: LOW * positive <= HIGH * negative <= HIGH * positive.
LOW, HIGH = 80, 100

# Bytes of a block, rows of a tile inside it, and the side below which plain multiplication is faster.
ANCHOR_BYTES, ROW_BYTES = 1 << 21, 1 << 23
TILE_ANCHORS, TILE_ROWS = 256, 2048
LEAF = 32
# Longest vector, in quantised units: by Cauchy-Schwarz no product exceeds 2^60.
LONGEST = 2.0**30
NONE = np.iinfo(np.int64).min

QUANTISED = "vec_id long, label long, length int, vector binary"


# --- quantised vectors -------------------------------------------------------------------------


def packed(values: np.ndarray) -> list[bytes]:
    """Each row of an int64 matrix in the least width that holds the matrix."""
    largest = np.abs(values).max(initial=0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if largest <= np.iinfo(k).max)
    return [row.tobytes() for row in values.astype(kind)]


def unpacked(rows: list[bytes], length: int) -> np.ndarray:
    """The int64 matrix of rows that may differ in width."""
    result = np.zeros((len(rows), length), dtype=np.int64)
    if length:
        widths = np.array([len(row) // length for row in rows])
        for width in np.unique(widths):
            chosen = np.flatnonzero(widths == width)
            joined = b"".join(rows[i] for i in chosen)
            result[chosen] = np.frombuffer(joined, dtype=f"<i{width}").reshape(-1, length)
    return result


def quantised_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The usable rows of (vec_id, label, vector) with their vectors quantised and packed."""
    vectors = batch.column("vector")
    lengths = np.array(pc.list_value_length(vectors).fill_null(0))
    flat = vectors.flatten()
    values = np.asarray(flat.fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(lengths)
    usable = np.array(vectors.is_valid()) & np.array(batch.column("label").is_valid())
    chosen, data = [], []
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        places = (ends[rows] - length)[:, None] + np.arange(length)
        found = np.floor(SCALE * values[places])
        finite = np.isfinite(values[places]).all(axis=1)
        rows, found = rows[finite], found[finite]
        if (np.hypot.reduce(found, axis=1) >= LONGEST).any():
            raise ValueError("vectors this long have inner products beyond 64-bit integers")
        chosen.append(rows)
        data += packed(found.astype(np.int64))
    rows = np.concatenate([*chosen, np.empty(0, dtype=np.int64)]).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("vec_id").take(pa.array(rows)),
            batch.column("label").take(pa.array(rows)),
            pa.array(lengths[rows].astype(np.int32)),
            pa.array(data, pa.binary()),
        ],
        names=["vec_id", "label", "length", "vector"],
    )


# --- tiles -------------------------------------------------------------------------------------


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven products of quarters, recursively."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    product = np.empty((2 * i, 2 * l), dtype=np.int64)
    product[:i, :l] = m1 + m4 - m5 + m7
    product[:i, l:] = m3 + m5
    product[i:, :l] = m2 + m4
    product[i:, l:] = m1 - m2 + m3 + m6
    return product[:m, :n]


def heads(scores: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``size`` largest of each row; equal scores by column, NONE never."""
    size_here = min(size, scores.shape[1])
    if not size_here:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    least = np.partition(scores, scores.shape[1] - size_here, axis=1)[:, -size_here]
    rows, columns = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < size
    return rows[kept], columns[kept]


def tiles(
    anchors: list[bytes], rows: list[bytes], length: int
) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of all anchors and rows, a tile at a time."""
    asked = unpacked(anchors, length)
    for j in range(0, len(rows), TILE_ROWS):
        b = slice(j, j + TILE_ROWS)
        stored = np.ascontiguousarray(unpacked(rows[b], length).T)
        for i in range(0, len(anchors), TILE_ANCHORS):
            a = slice(i, i + TILE_ANCHORS)
            yield a, b, strassen(asked[a], stored)


def in_order(found: pd.DataFrame) -> pd.DataFrame:
    """Candidates as ties are broken: by id, those without one last."""
    return found.sort_values(["no_id", "c_id", "c_row"]).reset_index(drop=True)


# --- Spark -------------------------------------------------------------------------------------


def quantised(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per usable vector: ``row``, ``vec_id``, ``label``, ``length``, packed ``vector``."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield quantised_batch(batch)

    chosen = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    found = chosen.mapInArrow(usable, QUANTISED)
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))


def row_bytes() -> Column:
    """About what a row takes in a block: its vector and some columns."""
    return F.octet_length("vector") + 64


def total_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(row_bytes())).first()[0] or 0


def _best(heaps: DataFrame, size: int, *key: str) -> DataFrame:
    """Heaps merged: the ``size`` best of each key, ranked from 1."""
    ranked = Window.partitionBy(*key).orderBy(F.desc("score"), "no_id", "c_id", "c_row")
    return heaps.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= size)


def _candidates(rows: DataFrame, anchor_blocks, row_blocks) -> DataFrame:
    """Candidates dealt to their block, once for each block of anchors."""
    return rows.select(
        F.col("length"),
        F.col("label").alias("c_label"),
        F.col("row").alias("c_row"),
        F.coalesce("vec_id", F.lit(0)).alias("c_id"),
        F.col("vec_id").isNull().cast("int").alias("no_id"),
        F.col("vector").alias("c_vector"),
        F.pmod(F.xxhash64("row"), row_blocks).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), (anchor_blocks - 1).cast("int"))).alias("anchor_block"),
    )


def _anchors(rows: DataFrame, anchor_blocks, row_blocks, *extra: str) -> DataFrame:
    """Anchors dealt to their block, once for each block of candidates."""
    return rows.select(
        F.col("length").alias("a_length"),
        F.col("label").alias("a_label"),
        F.col("row").alias("a_row"),
        F.col("vector").alias("a_vector"),
        *extra,
        F.pmod(F.xxhash64("row", F.lit("anchor")), anchor_blocks).cast("int").alias("a_block"),
        F.explode(F.sequence(F.lit(0), (row_blocks - 1).cast("int"))).alias("b_block"),
    )


def positives(rows: DataFrame, anchor: str, size: int = POSITIVES) -> DataFrame:
    """(``a_row``, ``place``, ``score``, ``c_id``, ``no_id``): the nearest rows of an anchor's label.

    Blocks lie within a label and a length, as many as the label's size asks for.
    """
    counts = rows.groupBy("length", "label").agg(
        F.ceil(F.sum(F.when(F.expr(anchor), row_bytes())) / ANCHOR_BYTES).alias("anchor_blocks"),
        F.ceil(F.sum(row_bytes()) / ROW_BYTES).alias("row_blocks"),
    )
    counts = cut_lineage(counts.filter("anchor_blocks > 0"))
    sized = rows.join(counts, ["length", "label"])
    blocks = F.col("anchor_blocks"), F.col("row_blocks")
    asked = _anchors(sized.filter(anchor), *blocks).groupBy(
        "a_length", "a_label", "a_block", "b_block"
    )
    stored = _candidates(sized, *blocks).groupBy("length", "c_label", "anchor_block", "row_block")

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["a_row", "c_row", "c_id", "no_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        right = in_order(right)
        vectors = list(left["a_vector"]), list(right["c_vector"])
        a_row, c_row = left["a_row"].to_numpy(), right["c_row"].to_numpy()
        parts = []
        for i, j, scores in tiles(*vectors, key[0]):
            scores[a_row[i][:, None] == c_row[j][None, :]] = NONE
            at, to = heads(scores, size)
            part = right.iloc[j.start + to][["c_row", "c_id", "no_id"]]
            parts.append(part.assign(a_row=a_row[i.start + at], score=scores[at, to]))
        return pd.concat(parts)[names]

    heaps = asked.cogroup(stored).applyInPandas(
        best, "a_row long, c_row long, c_id long, no_id int, score long"
    )
    return _best(heaps, size, "a_row").withColumnRenamed("rank", "place")


def mined(
    rows: DataFrame,
    anchor: str,
    positive_count: int = POSITIVES,
    negative_count: int = NEGATIVES,
) -> DataFrame:
    """Hard negatives of all anchors among ``rows`` (see ``quantised``), ``anchor`` in SQL.

    Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``.
    """
    near = cut_lineage(positives(rows, anchor, positive_count))
    targets = near.groupBy("a_row").agg(
        F.array_sort(F.collect_list(F.struct("place", "score"))).alias("targets")
    )
    asking = cut_lineage(
        rows.filter(anchor).join(targets.withColumnRenamed("a_row", "row"), "row")
    )
    anchor_blocks = F.lit(-(-total_bytes(asking) // ANCHOR_BYTES) or 1)
    # Small tables are dealt over the shuffle partitions as well, large ones by size alone.
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = F.lit(max(least, -(-total_bytes(rows) // ROW_BYTES)))
    asked = _anchors(asking, anchor_blocks, row_blocks, "targets").groupBy(
        "a_length", "a_block", "b_block"
    )
    stored = _candidates(rows, anchor_blocks, row_blocks).groupBy(
        "length", "anchor_block", "row_block"
    )

    def windows(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["a_row", "place", "c_row", "c_id", "no_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        right = in_order(right)
        vectors = list(left["a_vector"]), list(right["c_vector"])
        a_row, a_label = left["a_row"].to_numpy(), left["a_label"].to_numpy()
        c_label = right["c_label"].to_numpy()
        bounds = [[step["score"] for step in found] for found in left["targets"]]
        parts = []
        for i, j, scores in tiles(*vectors, key[0]):
            scores[a_label[i][:, None] == c_label[j][None, :]] = NONE
            for place in range(positive_count):
                # Anchors with fewer positives have no window here.
                asks = np.array([len(b) > place for b in bounds[i]])
                top = np.array([b[place] if len(b) > place else 0 for b in bounds[i]])[:, None]
                # LOW * p <= HIGH * n as n >= ceil(LOW * p / HIGH), without leaving 64 bits.
                low = top // HIGH * LOW - (-(top % HIGH) * LOW // HIGH)
                inside = (scores <= top) & (scores >= low) & asks[:, None]
                at, to = heads(np.where(inside, scores, NONE), negative_count)
                part = right.iloc[j.start + to][["c_row", "c_id", "no_id"]]
                parts.append(
                    part.assign(a_row=a_row[i.start + at], place=place + 1, score=scores[at, to])
                )
        return pd.concat(parts)[names]

    heaps = asked.cogroup(stored).applyInPandas(
        windows, "a_row long, place int, c_row long, c_id long, no_id int, score long"
    )
    found = _best(heaps, negative_count, "a_row", "place").select(
        "a_row",
        "place",
        "rank",
        F.when(F.col("no_id") == 0, F.col("c_id")).alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    named = near.select(
        "a_row",
        "place",
        F.when(F.col("no_id") == 0, F.col("c_id")).alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    anchors = rows.filter(anchor).select(
        F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id")
    )
    return (
        found.join(named, ["a_row", "place"])
        .join(anchors, "a_row")
        .select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )
    )
