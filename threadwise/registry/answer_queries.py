"""Model answers ingested (M), and tables and the index written and read back (A)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadwise.operators import index_store, model_tables, similarity, threads
from threadwise.registry import evaluation_queries as evaluation
from threadwise.registry import inputs, retrieval_queries
from threadwise.registry import sqltext as sql
from threadwise.registry.catalog import query
from threadwise.registry.inputs import BRAND, SUPPORT_TURNS, TWEETS
from threadwise.rules import wording
from threadwise.session import cut_lineage, shared_folder
from threadwise.sources import schemas, tables

# --- M: answers -----------------------------------------------------------------------------------
# Every message gets an answer by its id: usable, fenced, broken or beside the point.

LABELS = ("card_atm_issue", "app_store_issue", "order_shipping_issue")
_LABEL = "CASE msg_id % 3 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, name in enumerate(LABELS)
) + " END"
_INTENT_ANSWER = f"""
concat('{{"intent": "', {_LABEL}, '", "confidence": 0.7, "reasoning": "ok"}}')"""


@query(
    sql.with_(sql.CLASSIFIED)
    + f"""
SELECT msg_id,
       CASE WHEN NOT needs_model OR msg_id % 4 = 2 THEN intent
            WHEN msg_id % 4 = 3 THEN 'other_general' ELSE {_LABEL} END AS intent,
       CASE WHEN NOT needs_model OR msg_id % 4 = 2 THEN confidence
            WHEN msg_id % 4 = 3 THEN 0.9 ELSE 0.7 END AS confidence,
       CASE WHEN NOT needs_model THEN reasoning
            WHEN msg_id % 4 = 2
              THEN concat({sql.lit(wording.MODEL_FALLBACK_PREFIX % "invalid JSON")}, reasoning)
            WHEN msg_id % 4 = 3 THEN '' ELSE 'ok' END AS reasoning,
       CASE WHEN NOT needs_model THEN 'rules' WHEN msg_id % 4 = 2 THEN 'fallback' ELSE 'model' END
         AS intent_source
FROM classified"""
)
def m5_ingested_intents(spark, sf_dir):
    messages = inputs.messages(spark, sf_dir)
    answers = messages.selectExpr(
        "msg_id",
        f"CASE msg_id % 4 WHEN 0 THEN {_INTENT_ANSWER} "
        f"WHEN 1 THEN concat('```json\\n', {_INTENT_ANSWER}, '\\n```') WHEN 2 THEN 'I think {{it is' "
        "WHEN 3 THEN '{\"intent\": \"weather\", \"confidence\": 0.9}' END AS response",
    )
    return model_tables.ingest_intents(messages, answers).select(
        "msg_id", "intent", "confidence", "reasoning", "intent_source"
    )


_ANSWERED = "reply_source <> 'known' AND msg_id % 3 < 2"


@query(
    sql.whole_texts(
        sql.with_(sql.triage_ctes())
        + f""",
full_support AS (
  SELECT msg_id FROM backed WHERE grp IN ('restart', 'settings') GROUP BY msg_id HAVING count(*) = 2)
SELECT msg_id,
       CASE WHEN NOT ({_ANSWERED}) THEN reply WHEN msg_id % 3 = 0 THEN 'restart it, then open settings'
            ELSE {sql.lit(wording.GENERATION_ERROR_REPLY)} END AS reply,
       CASE WHEN NOT ({_ANSWERED}) THEN reply_source WHEN msg_id % 3 = 0 THEN 'model' ELSE 'error' END
         AS reply_source,
       CASE WHEN NOT ({_ANSWERED}) THEN generation_model WHEN msg_id % 3 = 0 THEN 'some-model'
            ELSE 'error_fallback' END AS generation_model,
       CASE WHEN NOT ({_ANSWERED}) THEN answer_supported
            WHEN msg_id % 3 = 0 THEN msg_id IN (SELECT msg_id FROM full_support) ELSE FALSE END
         AS answer_supported
FROM routed"""
    )
)
def m6_ingested_replies(spark, sf_dir):
    drafts = inputs.triaged_with_cases(spark, sf_dir, whole=True)
    answers = inputs.triaged(spark, sf_dir, whole=True).where("msg_id % 3 < 2").selectExpr(
        "msg_id",
        "CASE WHEN msg_id % 3 = 0 THEN '\\n restart it, then open settings  ' END AS response",
    )
    return model_tables.ingest_replies(drafts, answers, "some-model").select(
        "msg_id", "reply", "reply_source", "generation_model", "answer_supported"
    )


@query(
    sql.with_(sql.triage_ctes())
    + f"""
SELECT msg_id,
       CASE WHEN cases = 0 OR msg_id % 3 = 1 THEN grounding = 'supported' ELSE msg_id % 3 = 2 END
         AS grounded,
       CASE WHEN cases = 0 OR msg_id % 3 = 1 THEN grounding_reason WHEN msg_id % 3 = 0 THEN 'no'
            ELSE {sql.lit(wording.GROUNDING_DEFAULT_REASON)} END AS grounding_reason
FROM routed"""
)
def m6_ingested_grounding(spark, sf_dir):
    drafts = inputs.triaged(spark, sf_dir)
    answers = drafts.selectExpr(
        "msg_id",
        "CASE msg_id % 3 WHEN 0 THEN '{\"grounded\": false, \"reason\": \"no\"}' "
        "WHEN 1 THEN 'yes' ELSE '{\"grounded\": true}' END AS response",
    )
    return model_tables.ingest_grounding(drafts, answers).select(
        "msg_id", "grounded", "grounding_reason"
    )


_MODEL_SCORES = (5, 1, 4, 2, 3)
_JUDGE_NAMES = [f"judge_{name}" for name in tables.schemas.DIMENSIONS]


@query(
    sql.with_(evaluation.JUDGED)
    + "\nSELECT conversation_id, "
    + ", ".join(
        f"CASE WHEN CAST(conversation_id AS BIGINT) % 3 = 0 THEN {score} ELSE {name} END AS {name}"
        for name, score in zip(_JUDGE_NAMES, _MODEL_SCORES)
    )
    + f""",
       CASE CAST(conversation_id AS BIGINT) % 3 WHEN 0 THEN 'ok'
            WHEN 1 THEN {sql.lit(wording.JUDGE_FALLBACK_PREFIX % "unusable answer" + wording.JUDGE_REASONING)}
            ELSE {sql.lit(wording.JUDGE_REASONING)} END AS judge_reasoning
FROM judged"""
)
def m7_ingested_judgements(spark, sf_dir):
    results = evaluation.results(spark, sf_dir)
    answers = results.where("cast(conversation_id AS bigint) % 3 < 2").selectExpr(
        "conversation_id",
        "CASE WHEN cast(conversation_id AS bigint) % 3 = 1 THEN 'five out of five' ELSE "
        "'{\"correctness\": 9, \"groundedness\": 0, \"helpfulness\": 4.7, \"tone\": \"2\", "
        "\"reasoning\": \"ok\"}' END AS response",
    )
    return model_tables.ingest_judgements(results, answers).select(
        "conversation_id", *_JUDGE_NAMES, "judge_reasoning"
    )


# --- A: written and read back ---------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/threadwise-{name}-{uuid.uuid4().hex}"


@query(
    sql.with_(SUPPORT_TURNS)
    + f""",
numbered AS (SELECT *, text AS body FROM support_turns)
SELECT concat('conv_', CAST(root_tweet_id AS VARCHAR)) AS conversation_id,
       CAST(root_tweet_id AS VARCHAR) AS root_tweet_id,
       max(CASE WHEN turn_index = 0 THEN author_id END) AS customer_id,
       CAST(count(*) AS INTEGER) AS num_turns,
       max(CASE WHEN turn_index = 0 THEN {sql.strip_handles("body")} END) AS initial_query,
       arg_min(body, turn_index) FILTER (turn_index > 0 AND NOT inbound) AS first_support_reply,
       count(*) FILTER (turn_index > 0 AND NOT inbound) > 0 AS has_support_reply,
       string_agg(concat(CASE WHEN inbound THEN 'Customer' ELSE '{BRAND}' END, ': ', body), ' | '
                  ORDER BY turn_index) AS full_dialogue
FROM numbered GROUP BY root_tweet_id"""
)
def a5_conversations_read_back(spark, sf_dir):
    """Conversations written as CSV and scanned again."""
    folder = _folder(spark, "conversations")
    tables.write_flat(
        threads.flat_conversations(inputs.support_turns(spark, sf_dir), BRAND), folder, "csv"
    )
    read = tables.read_conversations(spark, folder, "csv")
    return read.drop("dialogue_head", "dialogue_chars")


# An export with line breaks and quotes in its texts, and with flags that are none in every seventh row.
_QUIRK = 'concat(text, chr(10), \'"quoted", again\')'


def _export(spark, sf_dir) -> str:
    """The tweets as several CSV files."""
    folder = _folder(spark, "export")
    rows = inputs.tweets(spark, sf_dir).select(
        *[
            F.expr("IF(ord % 7 = 0, 'maybe', cast(inbound AS string))").alias("inbound")
            if name == "inbound"
            else F.concat("text", F.lit('\n"quoted", again')).alias("text")
            if name == "text"
            else name
            for name in schemas.TWEETS.names
        ]
    )
    tables.write_flat(rows.repartition(5), folder, "csv")
    return folder


@query(
    sql.with_(TWEETS)
    + f"""
SELECT tweet_id, author_id, ord % 7 <> 0 AND inbound AS inbound, created_at, {_QUIRK} AS text,
       response_tweet_id, in_response_to_tweet_id FROM tweets"""
)
def a1_tweets_read_back(spark, sf_dir):
    """A raw export of several files, converted once and read."""
    converted = _folder(spark, "converted")
    tables.convert_tweets(spark, _export(spark, sf_dir), converted)
    return tables.read_converted(spark, converted).drop("ord")


@query(
    sql.with_(TWEETS)
    + """
SELECT 'rows' AS item, count(*) AS n, 5 AS files FROM tweets
UNION ALL SELECT 'malformed', 0, 5
UNION ALL SELECT 'inbound', count(*) FILTER (ord % 7 = 0), 5 FROM tweets
"""
    + "".join(
        f"UNION ALL SELECT '{name}', 0, 5\n" for name in schemas.TWEETS.names if name != "inbound"
    )
)
def a1_parse_report(spark, sf_dir):
    """What did not parse in a raw export, summed over its files."""
    report = tables.convert_tweets(spark, _export(spark, sf_dir), _folder(spark, "converted"))
    return report.groupBy("item").agg(
        F.sum("n").alias("n"), F.count_distinct("file").cast("int").alias("files")
    )


@query(
    sql.with_(SUPPORT_TURNS)
    + f"""
SELECT CAST(root_tweet_id AS VARCHAR) AS root_tweet_id,
       CAST(turn_index // 128 AS INTEGER) AS dialogue_part,
       string_agg(concat(CASE WHEN inbound THEN 'Customer' ELSE '{BRAND}' END, ': ', text), ' | '
                  ORDER BY turn_index) AS dialogue
FROM support_turns GROUP BY ALL"""
)
def a5_dialogues_read_back(spark, sf_dir):
    """The parts of all dialogues written in order as CSV and scanned again."""
    folder = _folder(spark, "dialogues")
    parts = cut_lineage(threads.dialogue_parts(inputs.support_turns(spark, sf_dir), BRAND))
    tables.write_flat(tables.in_file_order(parts, "root_tweet_id", "dialogue_part"), folder, "csv")
    return tables.read_dialogue_parts(spark, folder, "csv")


@query(
    sql.with_(SUPPORT_TURNS)
    + "\nSELECT root_tweet_id, turn_index, tweet_id, author_id, inbound, text FROM support_turns"
)
def a6_nested_read_back(spark, sf_dir):
    """Turns written as JSON, an array per part of a conversation, unnested again."""
    folder = _folder(spark, "nested")
    nested = cut_lineage(threads.turn_parts(inputs.support_turns(spark, sf_dir)))
    tables.write_nested(tables.in_file_order(nested, "root_tweet_id", "part"), folder)
    read = tables.read_table(spark, folder, nested.schema, "json")
    return read.select("root_tweet_id", F.inline("turns")).drop("created_at")


@query(retrieval_queries.RETRIEVED_SQL)
def a7_index_round_trip(spark, sf_dir):
    """Retrieval over the index as saved and loaded."""
    index = index_store.save_index(inputs.support_index(spark, sf_dir), _folder(spark, "index"))
    best = similarity.retrieve(inputs.messages(spark, sf_dir), index, columns=[])
    return best.select(
        "msg_id",
        F.col("record_id").alias("conversation_id"),
        F.col("rank").cast("long").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )
