import brute
from pyspark.sql import functions as F

from threadwise.llm import line_quality


def prose(start, count):
    """Words that hardly repeat."""
    return " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}word" for n in range(start, start + count))


def check(docs, min_documents=20):
    result = line_quality.with_verdict(
        docs.select("doc_id", "source", "text"), min_documents=min_documents
    ).collect()
    want = brute.verdicts([(r.source, r.text) for r in result], min_documents)
    for row, (measures, gone, kept) in zip(result, want, strict=True):
        assert {name: row[name] for name in measures} == measures
        assert (row.removed_words, row.kept) == (gone, kept)
        if not gone:
            assert row.clean_text == row.text
    return result


def test_awkward(awkward):
    check(awkward)


def test_frequent_lines(spark):
    rows = []
    for i in range(60):
        own = prose(100 + 9 * i, 60 if i % 2 else 8)
        rows.append((i, "h", f"{own}\n Shared LINE {i % 10}\n{prose(0, 64)}"))
    rows += [(100 + i, None, f"{prose(3 * i, 70)}\nshared line") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    result = check(docs, 5)
    rejected = {r.doc_id for r in result if not r.kept}
    assert rejected == set(range(0, 60, 2))
    short = next(r for r in result if r.doc_id == 0)
    assert short.clean_text == prose(100, 8)


def test_exact_copies_are_not_boilerplate(spark):
    text = "\n".join(prose(40 * n, 40) for n in range(8))
    rows = [(i, "h", text) for i in range(90)]
    rows += [(1000 + i, "h", prose(7 * i, 80)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert all(r.kept for r in check(docs))


def test_different_documents_are_counted_one_by_one(spark):
    """Texts that share all but one of their lines, and notices that differ in digits only."""
    text = "\n".join(prose(40 * n, 40) for n in range(8))
    rows = [(i, "h", f"{text}\nown end {prose(i, 1)} {'x' * i}") for i in range(31)]
    rows += [(100 + i, "notices", f"{prose(0, 60)} number {i}") for i in range(60)]
    rows += [(1000 + i, "h", prose(7 * i, 80)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in check(docs) if r.kept} == set(range(1000, 1040))


def test_the_limit_does_not_grow_with_the_host(spark):
    """A passage in one of thirty texts of a large host goes like one in a small host."""
    rows = [
        (i, "large", prose(3 * i, 60) + ("\nthe same passage" if i % 30 == 0 else f"\nend {'y' * i}"))
        for i in range(1500)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in check(docs) if r.removed_words} == set(range(0, 1500, 30))


def test_a_small_share_of_own_words_is_too_little(spark):
    shared = "\n".join(prose(60 * n, 60) for n in range(5))
    rows = [(i, "h", f"{shared}\n{prose(9 * i, own).replace('word', 'own')}") for i, own in enumerate([60] * 25 + [300])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [r.doc_id for r in check(docs) if r.kept] == [25]


def test_clashing_and_empty(spark, clashing, nothing):
    docs = clashing.withColumn("text", F.when(F.col("doc_id") > 100, F.lit(prose(0, 90))))
    accepted = line_quality.accepted(docs)
    assert accepted.columns == docs.columns
    assert accepted.filter("kept = 'own' AND n_words = 'own'").count() == accepted.count() == 39
    assert line_quality.accepted(nothing).columns == nothing.columns
    assert line_quality.with_verdict(nothing).count() == 0


def test_texts_of_accepted_documents_are_not_shuffled(spark, monkeypatch):
    """Lines are looked up where the texts lie, however many texts hold them; both ways agree."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [
            (i, ["a", "b", None][i % 3], f"{prose(5 * i, 70)}\nShared  {i % 4}\n{prose(0, 9)}\n\n{i}")
            for i in range(150)
        ]
        rows += [(500, "b", None), (501, None, ""), (502, "c", prose(0, 80)), (3, "a", rows[3][2])]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        result = line_quality.accepted(docs)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        found = sorted(map(tuple, result.collect()), key=str)
        monkeypatch.setattr(line_quality, "LOOKED_UP", 0)
        assert found == sorted(map(tuple, line_quality.accepted(docs).collect()), key=str)
        assert len(found) == 152 and not any("Shared" in text for _, _, text in found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
