import json

from pyspark.sql import functions as F

from threadwise.operators import intent, model_tables, replies
from threadwise.rules import wording

CASE = (
    "array<struct<rank: int, similarity_score: double, initial_query: string, "
    "first_support_reply: string, full_dialogue: string>>"
)


def answers(spark, *responses):
    return spark.createDataFrame(list(enumerate(responses)), "msg_id long, response string")


def ingest(spark, *responses, text="the battery drains"):
    df = spark.createDataFrame([(i, text) for i in range(len(responses))], "msg_id long, message string")
    rows = model_tables.ingest_intents(df, answers(spark, *responses)).orderBy("msg_id").collect()
    return rows if len(rows) > 1 else rows[0]


def test_usable_answer_wins(spark):
    row = ingest(
        spark,
        '```json\n{"intent": "card_atm_issue", "intents": ["order_shipping_issue", "nope", '
        '"order_shipping_issue", "card_atm_issue", "app_store_issue", "device_how_to"], '
        '"confidence": 0.7, "reasoning": "because"}\n```',
    )
    assert row.intents == ["order_shipping_issue", "card_atm_issue", "app_store_issue"]
    assert (row.intent, row.confidence) == ("order_shipping_issue", 0.7)
    assert (row.reasoning, row.intent_source) == ("because", "model")


def test_defaults_and_unknown_labels(spark):
    rows = ingest(
        spark, "{}", '{"intent": "nope"}', '{"intent": "app_store_issue", "intents": "x"}',
        '{"intent": "app_store_issue", "intents": []}',
    )
    assert [r.intent for r in rows] == [
        "other_general", "other_general", "app_store_issue", "app_store_issue",
    ]
    assert {r.confidence for r in rows} == {0.5}


def test_unusable_answers_fall_back_to_the_rules(spark):
    rows = ingest(spark, "not json", "[1, 2]", '{"confidence": "high"}', None)
    assert {r.intent for r in rows} == {"device_hardware_issue"}
    assert {r.intent_source for r in rows} == {"fallback"}
    prefix = wording.MODEL_FALLBACK_PREFIX % "invalid JSON"
    assert rows[0].reasoning == prefix + wording.HIT_REASONING % 1


def test_settled_messages_keep_the_rules(spark):
    row = ingest(spark, '{"intent": "app_store_issue"}', text="the phone is hot")
    assert (row.intent, row.intent_source) == ("device_hardware_issue", "rules")


def test_prompts(spark):
    df = spark.createDataFrame([(1, "the battery {drains}"), (2, "so hot")], "msg_id long, message string")
    prompts = model_tables.intent_prompts(intent.classify(df)).collect()
    assert [p.msg_id for p in prompts] == [1]
    assert prompts[0].prompt.endswith("the battery {drains}")
    assert '  - "card_atm_issue": ' in prompts[0].prompt


def test_evidence_blocks(spark):
    cases = [(1, 0.5, "q1", "r1", "d" * 301), (2, 0.25, "q" * 250, None, "short"), (3, 0.2, "q3", "r3", "d"),
             (4, 0.1, "q4", "r4", "d")]
    df = spark.createDataFrame([(cases,), ([],)], f"evidence {CASE}")
    blocks = [r[0] for r in df.select(model_tables.evidence_block(F.col("evidence"))).collect()]
    assert blocks[0].startswith('<case rank="1" score="0.500">\n<answer>r1</answer>\n<question>q1</')
    assert "d" * 300 + "</thread>" in blocks[0] and blocks[0].count("<thread shortened>") == 1
    assert blocks[0].count("</case>") == 4
    assert blocks[1] == wording.NO_EVIDENCE_BLOCK
    judge = [r[0] for r in df.select(model_tables.judge_block(F.col("evidence"))).collect()]
    assert 'rank="3"' in judge[0] and 'rank="4"' not in judge[0] and "q" * 201 not in judge[0]


def drafts(spark, rows):
    df = spark.createDataFrame(rows, f"msg_id long, message string, evidence {CASE}")
    return replies.generate_replies(intent.classify(df))


def test_reply_answers(spark):
    evidence = [(1, 0.5, "q", "restart and check settings", "")]
    base = drafts(
        spark,
        [(0, "nothing", evidence), (1, "nothing", evidence), (2, "nothing", evidence),
         (3, "my storage is full", evidence)],
    )
    rows = model_tables.ingest_replies(
        base, answers(spark, " Restart the phone. ", "Buy a cable.", None, "Something else"), "m1"
    ).orderBy("msg_id").collect()
    assert [(r.generation_model, r.answer_supported, r.grounded) for r in rows] == [
        ("m1", True, True), ("m1", False, False), ("error_fallback", False, False),
        ("deterministic_issue_handler", True, True),
    ]
    assert rows[0].reply == "Restart the phone."
    assert rows[2].reply == wording.GENERATION_ERROR_REPLY


def test_grounding_answers(spark):
    evidence = [(1, 0.5, "q", "contact us", "")]
    base = drafts(spark, [(i, "my storage is full", evidence if i < 4 else []) for i in range(5)])
    good = json.dumps({"grounded": True, "reason": "fits"})
    rows = model_tables.ingest_grounding(
        base, answers(spark, good, '{"grounded": false}', "broken", "{}", good)
    ).orderBy("msg_id").collect()
    assert [r.grounded for r in rows] == [True, False, False, False, False]
    assert rows[0].grounding_reason == "fits"
    assert rows[1].grounding_reason == wording.GROUNDING_DEFAULT_REASON
    assert rows[2].grounding_reason == wording.GROUNDING_REASONS["unsupported_action"]
    assert rows[4].grounding_reason == wording.GROUNDING_REASONS["no_evidence"]


def test_judge_answers(spark):
    results = spark.createDataFrame(
        [(i, "We are sorry, check the settings.", "[{}]") for i in range(4)],
        "msg_id long, reply string, evidence string",
    )
    full = {"correctness": 9, "groundedness": 0, "helpfulness": 4.7, "tone": "2", "reasoning": "ok"}
    rows = model_tables.ingest_judgements(
        results, answers(spark, json.dumps(full), "broken", '{"tone": "warm"}'), "msg_id"
    ).orderBy("msg_id").collect()
    got = [
        (r.judge_correctness, r.judge_groundedness, r.judge_helpfulness, r.judge_tone,
         r.judge_hallucination)
        for r in rows
    ]
    assert got == [(5, 1, 4, 2, 3)] + [(3, 3, 4, 4, 5)] * 3
    assert rows[0].judge_reasoning == "ok"
    assert rows[1].judge_reasoning.startswith(wording.JUDGE_FALLBACK_PREFIX.split("(")[0])
    assert rows[3].judge_reasoning == wording.JUDGE_REASONING
