"""Every registered query against its check SQL, and the driver contract."""

import oracle
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry
from threadwise.registry import inputs

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are absent")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(str(TESTDATA))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, connection, name):
    found = oracle.differences(QUERIES[name](spark, str(TESTDATA)), connection, SQL[name])
    assert not found, "\n".join(found)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(TESTDATA)).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rule_queries_are_not_degenerate(spark):
    triaged = QUERIES["h12_route"](spark, str(TESTDATA))
    assert triaged.select("rule").distinct().count() >= 5
    assert triaged.select("decision").distinct().count() == 2


@pytest.mark.parametrize(
    "name",
    ["g8_generate_replies", "i1_triage", "i2_triage_report", "k10_agent_results",
     "l13_rating_template", "m4_judge_prompts", "m6_ingested_replies"],
)
def test_triage_sql_has_whole_dialogues(name):
    assert "AS full_dialogue" in SQL[name] and "dialogue_head" not in SQL[name]


@pytest.mark.parametrize(
    "name",
    ["g8_generate_replies", "i1_triage", "i2_triage_report", "k10_agent_results",
     "l13_rating_template", "m4_judge_prompts", "m6_ingested_replies"],
)
def test_triage_sql_has_whole_messages(name):
    assert inputs.LATE_HOW_TO not in SQL[name] and inputs.LATE_PLAN not in SQL[name]


def test_later_questions_are_triaged_whole(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"own words {c} {t}")
             for c in (9, 10, 11) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    for name in ("i1_triage", "k10_agent_results", "i2_triage_report"):
        found = {r.message for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(found) == 6 and all("own words" in message for message in found)


def test_cases_of_whole_messages_have_whole_dialogues(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"own words {c} {t}")
             for c in (9, 10, 11) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    records = inputs.support_index(spark, str(tmp_path), whole=True).records.collect()
    assert len(records) == 3
    for r in records:
        assert all(f"own words {r.record_id} {t}" in r.full_dialogue for t in range(4))


def test_texts_of_turns_move_once(spark):
    turns = inputs.support_turns(spark, str(TESTDATA))
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan


def test_judged_results_have_whole_messages(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"own words {c} {t}")
             for c in (9, 10, 11) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    assert inputs.LATE_HOW_TO not in SQL["k8_judged_results"]
    assert inputs.LATE_PLAN not in SQL["k8_judged_results"]
    assert inputs.WHOLE_TEXT in SQL["k8_judged_results"]
    judged = QUERIES["k8_judged_results"](spark, str(tmp_path))
    found = {r.message for r in judged.collect()}
    assert len(found) == 6 and all("own words" in message for message in found)
    assert not oracle.differences(
        judged, oracle.connect(str(tmp_path)), SQL["k8_judged_results"]
    )


def test_term_frequencies_are_counted_within_the_vocabulary(spark, tmp_path):
    texts = [(1, "red fox red"), (1, "fox hunts"), (2, "red fox red"), (3, "the of"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = QUERIES["e7_term_frequency"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Join Inner" not in plan
    # A key that comes twice is one document.
    assert {(r.doc_id, r.term): r.tf for r in found.collect()} == {
        (1, "red"): 2, (1, "fox"): 2, (1, "hunts"): 1, (1, "red fox"): 1, (1, "fox red"): 1,
        (1, "fox hunts"): 1, (2, "red"): 2, (2, "fox"): 1, (2, "red fox"): 1, (2, "fox red"): 1,
    }
