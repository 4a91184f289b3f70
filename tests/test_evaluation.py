import math
import re
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from threadwise.operators import agreement, baselines, golden, metrics, quality
from threadwise.operators.tfidf import build_index, evidence_corpus
from threadwise.plans.evaluate import evaluate, rate_agreement, summary_rows
from threadwise.plans.prepare import prepare
from threadwise.sources import schemas, tables
from threadwise.sources.schemas import DIMENSIONS


# --- sources ---------------------------------------------------------------------------------------

CSV = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,ann,True,Tue Oct 31 22:10:47 +0000 2017,"@Desk my ""app""
does not install",2.0,
2,Desk,False,Tue Oct 31 22:11:45 +0000 2017,"try again, please &amp; wait",,1.0
3,bob,True,,no brand here,,
4,cy,,,@desk null flag,,
'''


def test_prepare_from_csv(spark, tmp_path):
    source = tmp_path / "export.csv"
    source.write_text(CSV)
    raw = tables.read_tweets(spark, str(source))
    assert [r.tweet_id for r in raw.orderBy("ord").collect()] == ["1", "2", "3", "4"]
    assert raw.where("tweet_id = '4'").first().inbound is False
    summary = prepare(spark, str(source), str(tmp_path / "out"), "Desk").first()
    assert (summary.conversations, summary.with_reply, summary.mean_turns) == (1, 1, 2.0)
    flat = tables.read_conversations(spark, str(tmp_path / "out/conversations")).first()
    assert flat.initial_query == 'my "app" does not install'
    assert flat.dialogue_head.endswith("| Desk: try again, please & wait")
    part = tables.read_dialogue_parts(spark, str(tmp_path / "out/dialogues")).first()
    assert part.dialogue == flat.dialogue_head and flat.dialogue_chars == len(part.dialogue)
    nested = spark.read.json(str(tmp_path / "out/conversations_nested")).first()
    assert [t.turn_index for t in nested.turns] == [0, 1]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_flat_round_trip(spark, tmp_path, fmt):
    rows = [("c1", 'say "hi"\nnow, \\ok', "x", "AUTO_HANDLE", None, "s", "reviewed", "n")]
    tables.write_flat(spark.createDataFrame(rows, schemas.GOLDEN), str(tmp_path / fmt), fmt)
    assert [tuple(r) for r in tables.read_golden(spark, str(tmp_path / fmt), fmt).collect()] == rows


# --- evaluation sets -----------------------------------------------------------------------------------

def test_quotas():
    shares = list(golden.quotas().values())
    assert shares == [19, 19] + [18] * 9 and sum(shares) == 200


def candidates(spark, n=400):
    rows = [
        (f"c{i}", f"the {'battery' if i % 3 else 'refund'} question number {i}", "reply", True)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows + [("short", "hi", "r", True), ("null", None, "r", True)],
        "conversation_id string, initial_query string, first_support_reply string, "
        "has_support_reply boolean",
    )


def test_golden_set_is_stratified_and_repeatable(spark):
    first = sorted(map(tuple, golden.golden_set(candidates(spark)).collect()))
    again = sorted(map(tuple, golden.golden_set(candidates(spark).repartition(5)).collect()))
    assert first == again
    counts = {r.intent: r["rows"] for r in golden.intent_breakdown(golden.golden_set(candidates(spark))).collect()}
    assert counts == {"device_hardware_issue": 19, "payment_billing_issue": 18}


def test_validate_golden(spark):
    good = spark.range(200).select(
        F.concat(F.lit("c"), "id").alias("conversation_id"),
        F.lit("m").alias("message"),
        F.lit("card_atm_issue").alias("intent"),
        F.lit("ESCALATE").alias("expected_action"),
        F.lit("s").alias("label_source"),
        F.when(F.col("id") < 5, "needs_review").otherwise("reviewed").alias("review_status"),
    )
    assert golden.validate_golden(good) == {"rows": 200, "intents": 1, "pending": 5}
    broken = {
        "manual review": (good, True),
        "row count": (good.limit(100), False),
        "unique": (good.withColumn("conversation_id", F.lit("x")), False),
        "taxonomy": (good.withColumn("intent", F.lit("x")), False),
        "expected_action": (good.withColumn("expected_action", F.lit(None).cast("string")), False),
        "missing columns": (good.drop("message"), False),
    }
    for message, (df, reviewed) in broken.items():
        with pytest.raises(ValueError, match=message):
            golden.validate_golden(df, reviewed)


@pytest.mark.parametrize("n", [5, 300, 2000, 5000])
def test_bounded_sample(spark, n):
    rows = spark.range(2000).select(F.col("id").alias("conversation_id"))
    everything = sorted(
        (r.h, r.conversation_id)
        for r in rows.withColumn("h", golden.draw_order("conversation_id")).collect()
    )
    drawn = [r.conversation_id for r in golden.bounded_sample(rows, n).collect()]
    assert sorted(drawn) == sorted(i for _, i in everything[:n])
    excluded = rows.where("conversation_id < 1990")
    assert golden.bounded_sample(rows, n, exclude_ids=excluded).count() == min(n, 10)


# --- metrics --------------------------------------------------------------------------------------------

def cells(spark, pairs):
    df = spark.createDataFrame(pairs, "t string, p string")
    return metrics.confusion(df, "t", "p")


def test_labels_only_predicted_or_only_true(spark):
    table = cells(spark, [("a", "a"), ("a", "b"), ("c", "a")])
    scores = {r.label: (r.precision, r.recall, r.f1) for r in metrics.label_scores(table).collect()}
    assert scores["b"] == (0.0, 0.0, 0.0) and scores["c"] == (0.0, 0.0, 0.0)
    assert scores["a"] == (0.5, 0.5, 0.5)
    row = metrics.intent_metrics(table).first()
    assert (row.accuracy, row.macro_f1, row.weighted_f1) == (0.3333, 0.1667, 0.3333)


def test_published_majority_row(spark):
    """27 of 200 right with one label out of 11: the known figures of a majority baseline."""
    names = [f"l{i}" for i in range(11)]
    truth = ["l0"] * 27 + [names[1 + i % 10] for i in range(173)]
    row = metrics.intent_metrics(cells(spark, [(t, "l0") for t in truth])).first()
    assert (row.accuracy, row.macro_f1, row.weighted_f1) == (0.135, 0.0216, 0.0321)


def test_published_escalation_row(spark):
    e, a = "ESCALATE", "AUTO_HANDLE"
    table = cells(spark, [(e, e)] * 99 + [(a, e)] * 94 + [(a, a)] * 7)
    row = metrics.binary_scores(table).first()
    assert (row.precision, row.recall, row.f1) == (0.513, 1.0, 0.6781)
    assert tuple(metrics.binary_counts(table).first()) == (99, 94, 0, 7)
    none = metrics.binary_scores(cells(spark, [(a, a)])).first()
    assert tuple(none) == (0.0, 0.0, 0.0)


def test_empty_means(spark):
    schema = ", ".join(f"judge_{d} int" for d in DIMENSIONS)
    rows = quality.mean_scores(spark.createDataFrame([], schema)).collect()
    assert {r["mean"] for r in rows} == {0.0} and len(rows) == 5


# --- agreement ---------------------------------------------------------------------------------------------

def ratings(spark, ids=("c1",), **scores):
    values = {d: "4" for d in DIMENSIONS} | scores
    return spark.createDataFrame(
        [(i, *[values[d] for d in DIMENSIONS]) for i in ids],
        "conversation_id string, " + ", ".join(f"{d} string" for d in DIMENSIONS),
    )


def test_valid_ratings(spark):
    results = spark.createDataFrame([("c1",)], "conversation_id string")
    agreement.validate_ratings(ratings(spark), results)


@pytest.mark.parametrize(
    "scores, ids, message",
    [
        ({"correctness": ""}, ("c1",), "from 1 to 5; check correctness"),
        ({"tone": "6", "helpfulness": None}, ("c1",), "check helpfulness, tone"),
        ({"tone": "3.5"}, ("c1",), "from 1 to 5"),
        ({}, ("c1", "c1"), "unique"),
        ({}, ("c9", "c8"), "missing from the results: c8, c9"),
        ({}, (), "no rows"),
    ],
)
def test_invalid_ratings(spark, scores, ids, message):
    results = spark.createDataFrame([("c1",)], "conversation_id string")
    with pytest.raises(ValueError, match=message):
        agreement.validate_ratings(ratings(spark, ids, **scores), results)
    with pytest.raises(ValueError, match="missing columns: tone"):
        agreement.validate_ratings(ratings(spark).drop("tone"))


def ranks(values):
    return [
        sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values
    ]


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return cov / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def test_agreement_numbers(spark):
    human, judge = [1, 2, 2, 3, 4, 5, 5, 5, 3, 1], [2, 2, 4, 3, 5, 5, 4, 1, 3, 3]
    rows = [("tone", float(h), float(j)) for h, j in zip(human, judge)]
    rows += [("correctness", 4.0, float(j)) for j in judge]
    df = spark.createDataFrame(rows, "dimension string, human double, judge double")
    got = {r.dimension: r for r in agreement.agreement(df).collect()}
    tone = got["tone"]
    assert (tone.percentage_agreement, tone.mean_abs_error, tone.n_samples) == (70.0, 1.1, 10)
    assert tone.pearson_r == round(pearson(human, judge), 4)
    assert tone.spearman_r == round(pearson(ranks(human), ranks(judge)), 4)
    assert (got["correctness"].pearson_r, got["correctness"].spearman_r) == (0.0, 0.0)


def test_rate_agreement_suffixes(spark):
    results = spark.createDataFrame(
        [("c1", "m", "r", 3, 3, 3, 3, 3)],
        "conversation_id string, message string, reply string, "
        + ", ".join(f"judge_{d} int" for d in DIMENSIONS),
    )
    rated = ratings(spark).withColumns({"message": F.lit("m"), "reply": F.lit("r")})
    joined = agreement.join_ratings(results, rated)
    assert {"message_judge", "message_human", "reply_judge", "reply_human"} <= set(joined.columns)
    rows = rate_agreement(results, rated).collect()
    assert {(r.percentage_agreement, r.mean_abs_error) for r in rows} == {(100.0, 1.0)}
    template = agreement.rating_template(results).first()
    assert (template.conversation_id, template.tone) == ("c1", "")


# --- violations, samples, documents -----------------------------------------------------------------------

def test_all_rating_violations_are_reported(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "conversation_id,Correctness,groundedness,helpfulness,hallucination\n"
        "c1,5,4,3,2\nc1,6,4,,2\nc2,3.5,4,x,2\nc9,1,1,1,1\n"
    )
    path = str(tmp_path / "r.csv")
    absent = tables.absent_columns(spark, path, schemas.HUMAN_RATINGS)
    assert absent == ["message", "reply", "tone"]
    results = spark.createDataFrame([("c1",), ("c2",)], "conversation_id string")
    ratings = tables.read_ratings(spark, path)
    found = agreement.rating_violations(ratings, results, ["tone"])
    assert sorted(map(tuple, found.collect())) == [
        ("invalid_score", "correctness", 2), ("invalid_score", "helpfulness", 2),
        ("missing_column", "tone", 0), ("repeated_id", "c1", 2), ("unknown_id", "c9", 1),
    ]
    empty = ratings.where("false")
    assert [r.check for r in agreement.rating_violations(empty).collect()] == ["empty"]
    nameless = ratings.select("correctness")
    checks = {(r.check, r.subject) for r in agreement.rating_violations(nameless, results).collect()}
    assert ("missing_column", "conversation_id") in checks and ("repeated_id", "c1") not in checks


def test_all_golden_violations_are_reported(spark):
    rows = [("a", "m", "odd", "AUTO_HANDLE", None, "s", "reviewed", "n")] * 2
    df = spark.createDataFrame(rows, schemas.GOLDEN)
    found = {(r.check, r.subject): r["rows"] for r in golden.golden_violations(df, ["notes"]).collect()}
    assert found == {
        ("missing_column", "notes"): 0, ("row_count", None): 1, ("unique_id", None): 1,
        ("known_intent", None): 2,
    }


@pytest.mark.parametrize("hot", [False, True])
def test_large_quotas_equal_a_full_ranking(spark, monkeypatch, hot):
    """A histogram draws the rows that ranking all of a label would draw."""
    names = list(golden.quotas())
    rows = [(f"c{i}", names[0 if hot and i % 3 else i % 5], i) for i in range(3000)] + [("x", "odd", 0)]
    labelled = spark.createDataFrame(rows, "conversation_id string, weak_label string, other int")
    for total in (0, 33, 4400, 11 * 2500):
        shares = golden.quotas(total)
        want = Counter()
        for name, share in shares.items():
            mine = [r for r in rows if r[1] == name]
            mine.sort(key=lambda r: md5(f"42:{r[0]}".encode()).hexdigest())
            want.update(mine[:share])
        assert Counter(map(tuple, golden.histogram_sample(labelled, shares).collect())) == want
    monkeypatch.setattr(golden, "WINDOW_QUOTA", 1)
    assert golden.stratified_sample(labelled, total=4400).columns == labelled.columns


def test_large_quotas_sort_no_whole_label(spark):
    labelled = spark.range(100).selectExpr("cast(id AS string) AS conversation_id", "'other_general' AS weak_label")
    sample = golden.stratified_sample(labelled, total=11 * 100_000)
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    (ranked,) = [part for part in plan.split("Window [")[1:] if part.startswith("row_number")]
    assert re.search(r"_head#\w+ = _last#", ranked)


def test_documents_as_rows(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"a": {"x": 1, "y": 2.5, "t": "text"}, "list": [{"name": "n 1", "v": 3}, {"name": "n 2", "v": null}], "n": 4}'
    )
    found = dict(map(tuple, summary_rows(spark.read.json(str(tmp_path / "d.json"))).collect()))
    assert found == {"a.x": 1.0, "a.y": 2.5, "list.n 1.v": 3.0, "list.n 2.v": None, "n": 4.0}


def test_conversion_keeps_and_counts_what_does_not_parse(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(CSV)
    (tmp_path / "in/b.csv").write_text(
        CSV.split("\n")[0] + '\n5,eve,perhaps,now,"two\nlines",,\n6,too,few\n7,a,True,now,ok,,,one,more\n'
    )
    report = tables.convert_tweets(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    found = {(r.file.rsplit("/", 1)[1], r.item): r.n for r in report.collect()}
    assert found["a.csv", "rows"] == 4 and found["b.csv", "rows"] == 3
    assert found["a.csv", "malformed"] == 0 and found["b.csv", "malformed"] == 2
    assert found["a.csv", "inbound"] == 0 and found["b.csv", "inbound"] == 2
    assert len(found) == 2 * (2 + len(schemas.TWEETS))
    kept = {r.tweet_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert kept["6"].malformed == "6,too,few" and kept["5"].unparsed == ["inbound"]
    tweets = tables.read_converted(spark, str(tmp_path / "out"))
    assert [r.tweet_id for r in tweets.orderBy("ord").collect()] == ["1", "2", "3", "4", "5", "6", "7"]
    assert tweets.where("tweet_id = '5'").first().text == "two\nlines"


# --- baselines and the whole run ------------------------------------------------------------------------------

def test_linear_baseline_learns(spark):
    rows = [(i, ("red fox " if i % 2 else "blue owl ") + f"n{i % 7}", "odd" if i % 2 else "even") for i in range(60)]
    train = spark.createDataFrame(rows, "msg_id long, message string, label string")
    model = baselines.fit_text_classifier(train)
    test = spark.createDataFrame([(1, "a red fox"), (2, "an owl, blue owl"), (3, "")], "msg_id long, message string")
    got = {r.msg_id: r.predicted for r in model.predict(test).collect()}
    assert (got[1], got[2]) == ("odd", "even") and got[3] in ("odd", "even")


def test_gradient_tells_a_fitted_model_from_another(spark):
    rows = [(i, f"word{i % 5} word{i % 3} tail{i % 2}", f"label{i * i % 4}") for i in range(80)]
    rows += [(90, None, "label0"), (91, "", "label1"), (92, "the of", "label0")]
    train = spark.createDataFrame(rows, "msg_id long, message string, label string")
    model = baselines.fit_text_classifier(train)
    cells = model.gradient(train).collect()
    terms = model.vocab.count()
    assert len(cells) == len(model.labels) * (terms + 1)
    assert max(abs(cell.gradient) for cell in cells) < 1e-6
    held = {cell.label: cell.held for cell in cells if cell.term_id is None}
    assert held == Counter(label for _, _, label in rows)
    model.coefficients = model.coefficients.withColumn(
        "coefficients", F.transform("coefficients", lambda x: x * 1.01)
    )
    assert max(abs(cell.gradient) for cell in model.gradient(train).collect()) > 1e-5


def test_every_row_is_learned_from(spark):
    n = 10_240
    word = "concat('word', id % 7, ' tail', id % 3)"
    label = "CASE WHEN id % 40 = 0 THEN 'rare' WHEN id % 7 < 3 THEN 'low' ELSE 'high' END"
    train = spark.range(n).selectExpr("id AS msg_id", f"{word} AS message", f"{label} AS label")
    model = baselines.fit_text_classifier(train)
    assert model.penalty == 1 / n
    assert {r.term: r.cf for r in model.vocab.collect()}["word0"] == sum(i % 7 == 0 for i in range(n))
    cells = model.gradient(train).collect()
    assert max(abs(cell.gradient) for cell in cells) < 1e-6
    # Rows without a key belong to no message: they change nothing.
    more = train.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS msg_id, 'lost' AS message, 'low' AS label"))
    assert baselines.fit_text_classifier(more).penalty == 1 / n


def test_one_label_is_always_predicted(spark):
    train = spark.createDataFrame([(1, "a word", "x"), (2, "b", "x")], "msg_id long, message string, label string")
    model = baselines.fit_text_classifier(train)
    assert [r.predicted for r in model.predict(train).collect()] == ["x", "x"]
    assert all(cell.gradient == 0 for cell in model.gradient(train).collect())


def test_majority_default(spark):
    empty = spark.createDataFrame([], "label string")
    assert baselines.majority_label(empty).first().majority == "other_general"
    tie = spark.createDataFrame([("b",), ("a",)], "label string")
    assert baselines.majority_label(tie).first().majority == "a"


def test_full_evaluation(spark, tmp_path):
    conversations = candidates(spark, 60)
    index = build_index(evidence_corpus(conversations))
    run = evaluate(golden.golden_set(conversations), conversations, index)
    run.write(str(tmp_path))
    names = {r.model for r in run.comparison.collect()}
    assert names == {"Majority Class", "TF-IDF + LogReg", "Agent"}
    summary = spark.read.json(str(tmp_path / "evaluation_summary")).first()
    assert len(summary.models) == 3 and len(summary.reply_quality) == 5
    judged = tables.read_judged(spark, str(tmp_path / "judged_results"))
    assert judged.count() == run.judged.count() == 37
    assert (tmp_path / "failures").exists() and (tmp_path / "class_report_agent").exists()
