import brute
import pytest

from threadwise.llm import mixing


def rows_of(df, *columns):
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def test_equals_brute_force(spark, awkward):
    result = mixing.mix(mixing.measure(awkward))
    rows = [(r.doc_id, r.source, r.text) for r in awkward.collect()]
    want = [(r[0], r[1], *m) for r, m in zip(rows, brute.mix(rows))]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    found = rows_of(result, "doc_id", "source", "size", "source_size", "target", "taken")
    for a, b in zip(found, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[5] == b[5]
        assert a[4] == pytest.approx(b[4])


def test_mix_repeats_and_drops(spark, clashing):
    result = mixing.mixed(clashing)
    assert result.columns == clashing.columns
    assert {r["size"] for r in result.select("size").collect()} == {"own"}
    taken = sum(len(brute.words(r.text)) for r in result.select("text").collect())
    sizes = sum(len(brute.words(r.text)) for r in clashing.select("text").collect())
    assert 0 < taken <= sizes


def test_sources_come_near_their_targets(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "repeat('w ', cast(id % 50 AS int)) AS text",
        "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 10 = 1 THEN NULL ELSE concat('s', id % 4) END AS source",
    )
    result = mixing.mix(mixing.measure(docs)).collect()
    for target, source_size in {(r.target, r.source_size) for r in result}:
        taken = sum(r.taken for r in result if (r.target, r.source_size) == (target, source_size))
        assert abs(taken - target) <= 100
    assert all(r.taken <= 3 * r["size"] for r in result)


def test_capped_targets(spark):
    docs = spark.createDataFrame(
        [(i, "w " * 10, "a" if i == 0 else "c" if i == 1 else "b") for i in range(40)],
        "doc_id long, text string, source string",
    )
    found = mixing.mix(mixing.measure(docs)).select("source", "target", "source_size").distinct()
    want = brute.targets({"a": 10, "b": 380, "c": 10})
    assert {r.source: r.target for r in found.collect()} == pytest.approx(want)


def test_empty(nothing):
    assert mixing.mix(mixing.measure(nothing)).count() == 0
    assert mixing.mixed(nothing).columns == nothing.columns
