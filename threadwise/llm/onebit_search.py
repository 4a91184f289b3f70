"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is scaled to unit length, padded and rotated at random, and only the signs of its
coordinates are kept, packed to bits, with two corrections: its length and the inner product of the
rotated vector with its own code. The inner product of a code with a rotated query, divided by that
correction, estimates the true one, and its error is bounded by a multiple (``EPSILON``) of a term
that only depends on the correction. Per block of vectors, the vectors with the best estimates are
compared exactly, which gives a score to beat; then every vector whose upper bound reaches it is
compared exactly. All vectors are indexed; nothing is fitted to the data.

Queries meet all vectors of their length block by block, an equi-join on the numbers of blocks, so a
task holds one block of queries and one of vectors and compares them slice by slice.

Defined results: null vectors and ids, zero vectors, and vectors with null or non-finite
components take no part; vectors are compared with those of their own length only; a query is not
its own neighbour, but an equal row is; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadwise.session import cut_lineage

SEED = 42
MIN_BITS = 128
# Standard errors of an estimate that its bound allows for.
EPSILON = 3.0
# Rows of a block, fewer where vectors are long, and queries compared at a time. Large blocks of
# queries are cheap to hold and keep the copies of vectors few.
QUERY_ROWS = 8192
VECTOR_ROWS = 8192
BLOCK_BYTES = 1 << 24
SLICE_ROWS = 512
# Vectors per query and block, as a multiple of k, compared first to find the score to beat.
FIRST = 5
# Rotations of vectors of several lengths that a task holds.
KEPT_ROTATIONS = 16

PARTS = ("row", "vec_id", "vector", "code", "norm", "own")
INDEX = "vec_id long, dimension int, vector binary, code binary, norm double, own double"


def code_bits(dimension: int) -> int:
    """Bits of a code: short vectors are padded, since the error falls with the code's length."""
    return max(MIN_BITS, -(-dimension // 64) * 64)


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """The part of a random rotation that acts on the unpadded coordinates (dimension x bits)."""
    bits = code_bits(dimension)
    turned, triangle = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (turned * np.sign(np.diag(triangle)))[:dimension]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, lengths, inner product of each unit vector with its code)."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / norms[:, None]) @ turn
    codes = np.packbits(turned > 0, axis=1)
    return codes, norms, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


def estimate(codes, own, turned_queries) -> tuple[np.ndarray, np.ndarray]:
    """(vectors x queries estimates for unit vectors, error bound of each vector)."""
    bits = turned_queries.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32)
    signs *= 2
    signs -= 1
    found = signs @ turned_queries.T.astype(np.float32)
    found /= (np.sqrt(bits) * own)[:, None].astype(np.float32)
    error = EPSILON * np.sqrt(np.maximum(1 - own * own, 0) / (own * own) / (bits - 1))
    return found, error.astype(np.float32)


def exact(vectors: np.ndarray, queries: np.ndarray, rows, columns) -> np.ndarray:
    """Inner products of pairs in double precision, summed from the first component on."""
    total = np.zeros(len(rows))
    for place in range(vectors.shape[1]):
        total += vectors[rows, place] * queries[columns, place]
    return total


def best(rows, columns, scores, ids, k: int) -> np.ndarray:
    """Places of the k best pairs of every query, ties to the smaller id."""
    order = np.lexsort((ids[rows], -scores, columns))
    grouped = columns[order]
    first = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def search_block(vectors: dict, queries: dict, turn: np.ndarray, k: int) -> tuple:
    """(query places, vector places, scores) of the best pairs of one block."""
    scaled = queries["vector"] / queries["norm"][:, None]
    found, error = estimate(vectors["code"], vectors["own"], scaled @ turn)
    lengths = vectors["norm"].astype(np.float32)
    found *= lengths[:, None]  # per unit length of the query, as are the bounds below
    own = np.nonzero(vectors["row"][:, None] == queries["row"][None, :])
    found[own] = -np.inf
    first = min(len(found), FIRST * k)
    rows = np.argpartition(-found, first - 1, axis=0)[:first].T.reshape(-1)
    columns = np.repeat(np.arange(found.shape[1]), first)
    scores = exact(vectors["vector"], queries["vector"], rows, columns)
    scores[np.isneginf(found[rows, columns])] = -np.inf
    by_query = np.sort(scores.reshape(-1, first), axis=1)
    to_beat = by_query[:, -k] if first >= k else np.full(found.shape[1], -np.inf)
    to_beat = (to_beat / queries["norm"]).astype(np.float32)
    found += (error * lengths)[:, None]
    # A margin for the single precision of estimates and bounds.
    reached = found >= (to_beat - 1e-5 * lengths.max())[None, :]
    reached[own] = False
    rows, columns = np.nonzero(reached)
    scores = exact(vectors["vector"], queries["vector"], rows, columns)
    chosen = best(rows, columns, scores, vectors["vec_id"], k)
    return columns[chosen], rows[chosen], scores[chosen]


# --- Spark -------------------------------------------------------------------------------------


def build_index(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per usable vector with its code; the index is written once."""
    sized = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")
    ).filter("vec_id IS NOT NULL AND size(vector) > 0")

    def coded(batch: pd.DataFrame, dimension: int, turn: np.ndarray) -> pd.DataFrame:
        values = np.stack([np.array(v, dtype=np.float64) for v in batch["vector"]])  # null: NaN
        usable = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        values = values[usable]
        codes, norms, own = encode(values, turn)
        return pd.DataFrame(
            {
                "vec_id": batch["vec_id"].to_numpy()[usable],
                "dimension": np.int32(dimension),
                "vector": [v.tobytes() for v in values],
                "code": [code.tobytes() for code in codes],
                "norm": norms,
                "own": own,
            }
        )

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned = functools.lru_cache(KEPT_ROTATIONS)(rotation)
        for batch in batches:
            for dimension, group in batch.groupby(batch["vector"].map(len)):
                yield coded(group, dimension, turned(dimension))

    found = sized.mapInPandas(index, INDEX)
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))


def _block(group: pd.DataFrame, prefix: str, dimension: int) -> dict:
    """The columns of a block as arrays."""
    column = {name: group[prefix + name] for name in PARTS}
    return {
        "row": column["row"].to_numpy(),
        "vec_id": column["vec_id"].to_numpy(),
        "vector": np.frombuffer(b"".join(column["vector"])).reshape(-1, dimension),
        "code": np.frombuffer(b"".join(column["code"]), dtype=np.uint8).reshape(len(group), -1),
        "norm": column["norm"].to_numpy(),
        "own": column["own"].to_numpy(),
    }


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """How many blocks the vectors of each length are dealt to."""
    held = F.greatest(
        F.lit(1), F.least(F.lit(most), F.expr(f"{BLOCK_BYTES} div (8 * dimension)"))
    )
    return rows.groupBy("dimension").agg(F.ceil(F.count("*") / F.first(held)).alias(name))


def _dealt(df: DataFrame, blocks: DataFrame, prefix: str, own: str, other: str) -> DataFrame:
    """Deal rows to blocks, and each row to every block of the other side."""
    return (
        df.join(blocks, "dimension")
        .select(
            *[F.col(name).alias(prefix + name) for name in PARTS],
            F.col("dimension").alias(prefix + "dimension"),
            F.pmod(F.xxhash64("row"), f"{own}s").alias(prefix + own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)).alias(
                prefix + other
            ),
        )
        .groupBy(prefix + "dimension", prefix + "query_block", prefix + "vector_block")
    )


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``); ``queries`` are rows of the index."""
    # One row per length. A table with n lengths holds n * n / 2 components at least, so they are
    # few beside it: 100 TB of single-precision vectors have 7 million at most.
    blocks = F.broadcast(
        _blocks(queries, QUERY_ROWS, "query_blocks").join(
            _blocks(index, VECTOR_ROWS, "vector_blocks"), "dimension"
        )
    )
    asked = _dealt(queries, blocks, "q_", "query_block", "vector_block")
    stored = _dealt(index, blocks, "v_", "vector_block", "query_block")

    def join(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        dimension = int(key[0])
        turn, block = rotation(dimension), _block(right, "v_", dimension)
        found = []
        for start in range(0, len(left), SLICE_ROWS):
            asking = _block(left[start : start + SLICE_ROWS], "q_", dimension)
            query, row, score = search_block(block, asking, turn, k)
            values = (asking["row"][query], asking["vec_id"][query], block["vec_id"][row], score)
            found.append(pd.DataFrame(dict(zip(names, values))))
        pairs = pd.concat(found)
        return pairs[np.isfinite(pairs["score"])]

    pairs = asked.cogroup(stored).applyInPandas(
        join, "query_row long, query_id long, vec_id long, score double"
    )
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
