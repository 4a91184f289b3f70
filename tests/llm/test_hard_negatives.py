"""Strassen tiles against plain products, and mined negatives against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from threadwise.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, step):
    """The hard negatives of the anchors whose id ``step`` divides, row by row."""
    usable = []
    for vec_id, vector, label in rows:
        if label is None or vector is None:
            continue
        if all(x is not None and math.isfinite(x) for x in vector):
            usable.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))

    def order(found):
        score, vec_id = found
        return -score, vec_id is None, vec_id or 0

    result = Counter()
    for i, (anchor, label, a) in enumerate(usable):
        if anchor is None or anchor % step:
            continue
        same, other = [], []
        for j, (vec_id, its, c) in enumerate(usable):
            if i != j and len(a) == len(c):
                (same if its == label else other).append(
                    (sum(x * y for x, y in zip(a, c)), vec_id)
                )
        for p, positive in sorted(same, key=order)[:5]:
            window = [n for n in other if 80 * p <= 100 * n[0] <= 100 * p]
            for rank, (n, negative) in enumerate(sorted(window, key=order)[:5], 1):
                result[anchor, positive, rank, negative, p, n] += 1
    return result


def found(spark, rows, step):
    vectors = hard_negatives.quantised(spark.createDataFrame(rows, SCHEMA))
    mined = hard_negatives.mined(vectors, f"vec_id % {step} = 0")
    return Counter(tuple(row) for row in mined.collect())


def random_rows(count, length, labels, seed):
    rng = random.Random(seed)
    return [
        (i, [rng.uniform(-1, 1) + 0.5 for _ in range(length)], rng.randrange(labels))
        for i in range(count)
    ]


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (33, 64, 17), (70, 35, 129), (4, 0, 3)])
@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_strassen_is_exact(shape, leaf):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-(2**27), 2**27, (m, k)), rng.integers(-(2**27), 2**27, (k, n))
    want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n))
    assert (hard_negatives.strassen(a, b, leaf) == want).all()


def test_strassen_near_the_limit():
    """Sums inside may wrap around 64 bits; the product is right all the same."""
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**29), 2**29, (9, 3)) + (1 << 29) // 2
    b = rng.integers(-(2**29), 2**29, (3, 9))
    want = a.astype(object) @ b.astype(object)
    assert (hard_negatives.strassen(a, b, 1) == want).all()


def test_heads_break_ties_by_place():
    scores = np.array([[3, 9, 9, 1, 9], [hard_negatives.NONE, 2, hard_negatives.NONE, 2, 1]])
    rows, columns = hard_negatives.heads(scores, 2)
    assert list(zip(rows, columns)) == [(0, 1), (0, 2), (1, 1), (1, 3)]
    rows, columns = hard_negatives.heads(scores, 9)
    assert [c for r, c in zip(rows, columns) if r == 1] == [1, 3, 4]


@pytest.mark.parametrize("length, labels", [(3, 2), (16, 10), (70, 3)])
def test_equals_plain(spark, length, labels):
    rows = random_rows(400, length, labels, length)
    want = plain(rows, 10)
    assert want and found(spark, rows, 10) == want


def test_blocks_merge(spark, monkeypatch):
    """The same rows whatever the size of blocks and tiles, with one hot label."""
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in random_rows(600, 8, 7, 5)]
    want = plain(rows, 5)
    for name, size in (("ANCHOR_BYTES", 2000), ("ROW_BYTES", 5000), ("TILE_ANCHORS", 3), ("TILE_ROWS", 7)):
        monkeypatch.setattr(hard_negatives, name, size)
    assert found(spark, rows, 5) == want


def test_awkward_rows(spark):
    ties = [(200 + i, [0.5, 0.25], i % 2) for i in range(40)]
    rows = [
        (0, [0.5, 0.25], 0),
        (0, [0.5, 0.25], 0),
        (0, [0.5, 0.3], 1),
        (None, [0.5, 0.25], 0),
        (None, [0.5, 0.25], 1),
        (10, None, 0),
        (20, [], 0),
        (21, [], 0),
        (22, [], 1),
        (30, [0.1, None], 0),
        (40, [float("nan"), 1.0], 0),
        (50, [float("inf"), 1.0], 0),
        (60, [0.5, 0.25], None),
        (70, [0.0, 0.0], 3),
        (71, [0.0, 0.0], 3),
        (-10, [-0.5, 0.1], 2),
        (-11, [-0.5, 0.2], 2),
        (80, [0.5], 0),
        (81, [0.5], 0),
        (82, [0.45], 1),
        (90, [4000.0, 1.0], 5),
        (91, [4000.0, 1.0], 5),
        (92, [3900.0, -1.0], 6),
        *ties,
    ]
    want = plain(rows, 10)
    assert any(key[0] == 20 for key in want) and any(key[0] == 80 for key in want)
    assert found(spark, rows, 10) == want


def test_empty_and_unusable_tables(spark):
    assert not found(spark, [], 10)
    assert not found(spark, [(10, None, 1), (20, [float("nan")], 2)], 10)


def test_other_columns_take_no_part(spark):
    rows = random_rows(60, 4, 2, 9)
    clashing = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'own' AS row", "'own' AS length", "'own' AS vector", "'own' AS score", "1 AS c_row"
    )
    mined = hard_negatives.mined(hard_negatives.quantised(clashing), "vec_id % 10 = 0")
    assert Counter(tuple(row) for row in mined.collect()) == plain(rows, 10)


def test_products_beyond_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="beyond 64-bit"):
        found(spark, [(0, [1e9, 0.0], 0), (1, [1e9, 0.0], 0)], 10)
