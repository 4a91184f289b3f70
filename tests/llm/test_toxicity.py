import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadwise.llm import toxicity

TESTDATA = Path("/root/testdata/sf0.01")
LEXICON = toxicity.Lexicon({"zork": 4.0}, {"blar": 3.0})


def values(text):
    return dict(zip(toxicity.FEATURES, toxicity.features(text, LEXICON)))


def test_features():
    found = values("You zork, blargh! nice day IDIOT i.d.i.o.t and 1d10t z0rk")
    assert found["insults"] > 0 and found["learned"] > 0 and found["beginnings"] > 0
    assert found["top_weight"] == 4.0
    assert found["near_reader"] > 0 and found["disguised_hits"] == 2
    assert values("zork " + "word " * 20 + "you")["near_reader"] == 0
    assert set(values("").values()) == {0.0}
    assert values("x" * 100_000)["repeated"] == 0.0


@pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are absent")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet")
    scores = toxicity.scored(docs, labels).select("doc_id", "held_out", "score", "predicted")
    rows = scores.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    seen = [r for r in rows if r.held_out and r.toxic is not None]
    toxic = [r.score for r in seen if r.toxic == 1]
    other = [r.score for r in seen if r.toxic == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other)
    assert wins / (len(toxic) * len(other)) > 0.75
    assert sum(r.predicted == r.toxic for r in seen) / len(seen) > 0.85


def test_one_label_only(spark, clashing):
    labels = spark.createDataFrame([(i, 0) for i in range(200)], "doc_id long, toxic int")
    result = toxicity.scored(clashing, labels)
    assert {r.score for r in result.collect()} == {0.0}
    assert result.filter("prediction = 'own'").count() == clashing.count()


def test_no_labels_null_labels_and_empty(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(awkward, labels).collect()} == {0.0}
    assert toxicity.scored(awkward, labels.limit(0)).count() == awkward.count()
    assert toxicity.scored(nothing, labels).count() == 0


def test_sample_is_bounded(spark):
    labels = spark.range(5000).select("id", F.lit(1).alias("toxic"))
    sample = toxicity.training_sample(labels, "id", "toxic", 500).collect()
    assert 300 < len(sample) < 700
    assert all(zlib.crc32(str(r.id).encode()) % 5 for r in sample)
