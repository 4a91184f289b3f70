import numpy as np

from threadwise.llm import onebit_search as search


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def neighbours(df, k):
    index = search.build_index(df)
    found = search.search(index, index.filter("vec_id % 20 = 0"), k).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


def inner(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def brute_force(vectors, ids, k):
    rows = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = [
            (-inner(vectors[q], vectors[i]), int(ids[i]))
            for i in range(len(ids))
            if i != q
        ]
        rows += [(int(ids[q]), r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return rows


def test_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_ROWS", 300)
    monkeypatch.setattr(search, "QUERY_ROWS", 20)
    monkeypatch.setattr(search, "SLICE_ROWS", 7)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1000, 24)).astype(np.float32) * rng.uniform(0.1, 4, (1000, 1))
    vectors = vectors.astype(np.float32)
    ids = np.arange(1000)
    found = neighbours(table(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, vectors)]), 20)
    want = brute_force(vectors, ids, 20)
    assert len(found) == len(want)
    hits = {r[::2] for r in found} & {r[::2] for r in want}
    assert len(hits) >= 0.98 * len(want)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(exact.get((q, i), s) == s for q, _, i, s in found)


def test_ties_few_and_unusable_vectors(spark):
    rows = [(i, [1.0, float(i % 2)], 0) for i in range(8)]
    rows += [(20, [1.0, 1.0], 0), (20, [1.0, 1.0], None), (None, [1.0, 1.0], 0)]
    rows += [(40, None, 0), (60, [0.0, 0.0], 0), (80, [None, 1.0], 0), (100, [float("nan"), 1.0], 0)]
    rows += [(120, [float("inf"), 1.0], 0), (140, [1.0], 0), (160, [], 0)]
    found = neighbours(table(spark, rows), 20)
    assert {r[0] for r in found} == {0, 20}
    of_zero = [r[2] for r in found if r[0] == 0]
    assert of_zero == [1, 2, 3, 4, 5, 6, 7, 20, 20]
    of_twenty = [r[2:] for r in found if r[0] == 20 and r[1] == 1]
    assert of_twenty == [(1, 2.0), (1, 2.0)]


def test_vectors_of_several_lengths_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 1 << 19)  # 43 rows of 1,500 components
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal((8, 33, 1500)[i % 3]).tolist()) for i in range(180)]
    found = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20)
    want = []
    for part in range(3):
        ids = np.array([i for i, *_ in rows if i % 3 == part])
        want += brute_force([np.array(rows[i][1]) for i in ids], ids, 20)
    assert len(found) == len(want) == 9 * 20
    assert len({r[::2] for r in found} & {r[::2] for r in want}) >= 0.98 * len(want)


def test_empty(spark):
    assert neighbours(table(spark, []), 20) == []


def test_bound_holds(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((500, 64))
    turn = search.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, norms, own = search.encode(vectors, turn)
    unit = vectors / norms[:, None]
    found, error = search.estimate(codes, own, unit @ turn)
    others = ~np.eye(500, dtype=bool)
    assert (np.abs(found - unit @ unit.T) <= error[:, None])[others].mean() > 0.99
