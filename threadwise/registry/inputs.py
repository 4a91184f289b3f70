"""Input tables derived from the given ones, for Spark and, as SQL text, for the checks.

The given ``conversations`` are invented prose without any support vocabulary, so each user turn
gets a problem phrase and each assistant turn a reply phrase in front of its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.operators.similarity import case_ids, with_cases
from threadwise.operators.tfidf import TfidfIndex, build_index, evidence_corpus
from threadwise.operators.threads import flat_conversations
from threadwise.plans.triage import triage
from threadwise.session import cut_lineage, settle, spread

BRAND = "BrandSupport"

PROBLEMS = (
    "the battery drains and the screen flickers",
    "it froze after the latest update",
    "my storage is almost full",
    "how do i record the screen",
    "someone hacked my account password",
    "i was charged twice for one purchase",
    "my debit card was declined",
    "please cancel my subscription trial",
    "the app will not download or install",
    "parcel tracking says my delivery was stolen",
    "",
    "just saying thanks for the help",
    "how can i take a screenshot",
    "how to remove an app i never use",
    "how do i connect to wi-fi at home",
    "how do i turn on dark mode",
    "how can i update my phone",
    "i forgot my password and cannot access my apple account",
    "need to recover my apple id",
    "someone changed my password last night",
    "the phone is stuck on the apple logo",
    "black screen since the ios update and it won't turn on",
    "the display is cracked",
    "there is no power and it will not power on",
    "the battery won't charge",
    "the phone gets hot and overheating warnings appear",
    "the phone keeps restarting",
    "i don't recognize this charge",
    "the app store shows an error",
    "is the tv+ plan included",
    "the order is late and my refund was not received",
    "the police say i may sue",
    "an unauthorized payment shows up",
    "tv+x and icloud+y stopped",
    "my account was compromised",
    "my identity details were used for theft",
    "the phone is unresponsive after the update",
    "i paid twice and want my money back",
    "the atm kept my credit card and my cash",
    "there is a double charge on my invoice",
    "is it legal to sell it without a charger",
)

REPLIES = (
    "please restart the device and check the settings",
    "try another charging cable and a different power port",
    "open settings and review what uses the storage",
    "our team can help, please contact support",
    "verify the account and start the password recovery",
    "share the receipt so billing can review the purchase transaction",
    "manage the subscription and cancel it there",
    "please share the model and version and what happened",
    "download the update and install it again from the store",
    "the support team will help you soon",
    "reboot the phone, then charge it with the original charger",
    "we promise a refund within 24 hours, definitely",
    "",
)


# Later questions in words that no first message of a conversation has: nothing is retrieved.
LATE_HOW_TO = "how do i enable wifi"
LATE_PLAN = "arcade membership"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table whose text columns are worked on: every core gets a share of it."""
    return spread(read(spark, sf_dir, table))


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw export: each user or assistant turn replies to an earlier one, forming a tree.

    Ids carry a decimal artefact, texts an escaped ampersand, a third of the conversations
    mention the brand, and every row has an older copy that must lose against it.
    """
    turns = read(spark, sf_dir, "conversations").where("role <> 'system'")
    rows = turns.selectExpr(
        "conv_id",
        "turn",
        "cast(conv_id * 100 + turn as string) AS tweet_id",
        f"CASE WHEN role = 'assistant' THEN '{BRAND}' ELSE concat('u', conv_id) END AS author_id",
        "role = 'user' AS inbound",
        "concat('t', turn) AS created_at",
        f"concat(CASE WHEN conv_id % 3 = 0 THEN '@{BRAND} ' ELSE '' END, "
        "replace(text, ' and ', ' &amp; ')) AS text",
        "CASE WHEN turn > 0 THEN concat(conv_id * 100 + (turn - 1) div 2, '.0') END "
        "AS in_response_to_tweet_id",
        "conv_id * 1000 + turn AS ord",
    )
    children = (
        rows.where("in_response_to_tweet_id IS NOT NULL")
        .groupBy(F.substring_index("in_response_to_tweet_id", ".", 1).alias("tweet_id"))
        .agg(F.array_join(F.sort_array(F.collect_list("tweet_id")), ", ").alias("response_tweet_id"))
    )
    rows = rows.join(children, "tweet_id", "left").drop("conv_id", "turn")
    older = rows.withColumn("text", F.concat(F.lit("draft "), "text")).withColumn(
        "ord", F.col("ord") - 500
    )
    return rows.unionByName(older)


TWEETS = f"""
tweets_base AS (
  SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS tweet_id,
         CASE WHEN role = 'assistant' THEN '{BRAND}'
              ELSE concat('u', CAST(conv_id AS VARCHAR)) END AS author_id,
         role = 'user' AS inbound,
         concat('t', CAST(turn AS VARCHAR)) AS created_at,
         concat(CASE WHEN conv_id % 3 = 0 THEN '@{BRAND} ' ELSE '' END,
                replace(text, ' and ', ' &amp; ')) AS text,
         CASE WHEN turn > 0 THEN concat(CAST(conv_id * 100 + (turn - 1) // 2 AS VARCHAR), '.0') END
           AS in_response_to_tweet_id,
         conv_id * 1000 + turn AS ord
  FROM conversations WHERE role <> 'system'),
tweets_children AS (
  SELECT split_part(in_response_to_tweet_id, '.', 1) AS tweet_id,
         string_agg(tweet_id, ', ' ORDER BY tweet_id) AS response_tweet_id
  FROM tweets_base WHERE in_response_to_tweet_id IS NOT NULL GROUP BY 1),
tweets_linked AS (
  SELECT b.*, c.response_tweet_id FROM tweets_base b LEFT JOIN tweets_children c USING (tweet_id)),
tweets AS (
  SELECT tweet_id, author_id, inbound, created_at, text, in_response_to_tweet_id,
         response_tweet_id, ord FROM tweets_linked
  UNION ALL
  SELECT tweet_id, author_id, inbound, created_at, concat('draft ', text),
         in_response_to_tweet_id, response_tweet_id, ord - 500 FROM tweets_linked)"""


def _phrase_array(phrases: tuple[str, ...]) -> str:
    return "array(" + ", ".join("'" + p.replace("'", "\\'") + "'" for p in phrases) + ")"


def support_turns(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(root_tweet_id, turn_index, tweet_id, author_id, inbound, text, created_at).

    The later questions of some conversations are fixed phrases, unless ``whole`` texts are wanted.
    """
    late = "" if whole else (
        f"WHEN role = 'user' AND turn > first_turn AND conv_id % 9 = 0 THEN '{LATE_HOW_TO}' "
        f"WHEN role = 'user' AND turn > first_turn AND conv_id % 9 = 1 THEN '{LATE_PLAN}' "
    )
    turns = read(spark, sf_dir, "conversations").where("role <> 'system'")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    # Texts move once, to the small side of the join, and are not sorted for it.
    return turns.join(first.hint("shuffle_hash"), "conv_id").selectExpr(
        "conv_id AS root_tweet_id",
        "cast(turn - first_turn AS int) AS turn_index",
        "conv_id * 100 + turn AS tweet_id",
        f"CASE WHEN role = 'assistant' THEN '{BRAND}' ELSE concat('u', conv_id) END AS author_id",
        "role = 'user' AS inbound",
        f"CASE {late}WHEN true THEN "
        "trim(concat(CASE WHEN role = 'user' "
        f"THEN {_phrase_array(PROBLEMS)}[cast((conv_id * 31 + turn) % {len(PROBLEMS)} AS int)] "
        f"ELSE {_phrase_array(REPLIES)}[cast((conv_id * 31 + turn) % {len(REPLIES)} AS int)] END, "
        "' ', text)) END AS text",
        "concat('t', turn) AS created_at",
    )


def _values(phrases: tuple[str, ...]) -> str:
    return ", ".join(
        f"({i}, '{p}')" for i, p in enumerate(q.replace("'", "''") for q in phrases)
    )


WHOLE_TEXT = """trim(concat(CASE WHEN c.role = 'user' THEN p.phrase ELSE r.phrase END,
                               ' ', c.text))"""
LATE_TEXT = f"""CASE WHEN c.role = 'user' AND c.conv_id % 9 < 2
                   AND c.turn > min(c.turn) OVER (PARTITION BY c.conv_id)
              THEN CASE c.conv_id % 9 WHEN 0 THEN '{LATE_HOW_TO}' ELSE '{LATE_PLAN}' END
              ELSE {WHOLE_TEXT} END"""
SUPPORT_TURNS = f"""
problems(pid, phrase) AS (VALUES {_values(PROBLEMS)}),
replies(rid, phrase) AS (VALUES {_values(REPLIES)}),
support_turns AS (
  SELECT c.conv_id AS root_tweet_id,
         CAST(c.turn - min(c.turn) OVER (PARTITION BY c.conv_id) AS INTEGER) AS turn_index,
         c.conv_id * 100 + c.turn AS tweet_id,
         CASE WHEN c.role = 'assistant' THEN '{BRAND}'
              ELSE concat('u', CAST(c.conv_id AS VARCHAR)) END AS author_id,
         c.role = 'user' AS inbound,
         {LATE_TEXT} AS text,
         concat('t', CAST(c.turn AS VARCHAR)) AS created_at
  FROM conversations c
  JOIN problems p ON p.pid = (c.conv_id * 31 + c.turn) % {len(PROBLEMS)}
  JOIN replies r ON r.rid = (c.conv_id * 31 + c.turn) % {len(REPLIES)}
  WHERE c.role <> 'system')"""


def messages(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(msg_id, conv_id, message): every user turn."""
    return (
        support_turns(spark, sf_dir, whole)
        .where("inbound")
        .select(
            F.col("tweet_id").alias("msg_id"),
            F.col("root_tweet_id").alias("conv_id"),
            F.col("text").alias("message"),
        )
    )


MESSAGES = SUPPORT_TURNS + """,
messages AS (
  SELECT tweet_id AS msg_id, root_tweet_id AS conv_id, text AS message
  FROM support_turns WHERE inbound)"""


def support_conversations(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Conversation records with their whole dialogue; ids are numbers."""
    return (
        flat_conversations(support_turns(spark, sf_dir, whole), BRAND)
        .withColumn("conversation_id", F.col("root_tweet_id"))
        .drop("dialogue_head", "dialogue_chars")
    )


_LINES = """string_agg(concat(CASE WHEN inbound THEN 'Customer' ELSE 'BrandSupport' END, ': ',"""
DIALOGUE_HEAD = f"""         left({_LINES}
                                text), ' | ' ORDER BY turn_index), 1000) AS dialogue_head"""
FULL_DIALOGUE = f"""         {_LINES} text),
                    ' | ' ORDER BY turn_index) AS full_dialogue"""

# Written independently of the thread operators: the first turn and the first brand turn.
SUPPORT_CONVERSATIONS = MESSAGES + f""",
support_conversations AS (
  SELECT root_tweet_id AS conversation_id,
         max(CASE WHEN turn_index = 0 THEN author_id END) AS customer_id,
         CAST(count(*) AS INTEGER) AS num_turns,
         max(CASE WHEN turn_index = 0 THEN trim(regexp_replace(text, '[\\s\\x{{A0}}]+', ' ', 'g')) END)
           AS initial_query,
         arg_min(text, turn_index) FILTER (turn_index > 0 AND NOT inbound) AS first_support_reply,
{DIALOGUE_HEAD}
  FROM support_turns GROUP BY root_tweet_id),
corpus AS (
  SELECT * FROM support_conversations
  WHERE first_support_reply IS NOT NULL AND first_support_reply <> '' AND initial_query <> '')"""


_STORED: dict[tuple, object] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build):
    """Build a table or index once per session and scale, as a deployment would."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def support_index(spark: SparkSession, sf_dir: str, whole: bool = False) -> TfidfIndex:
    """The retrieval index over past conversations."""

    def build() -> TfidfIndex:
        corpus = evidence_corpus(cut_lineage(support_conversations(spark, sf_dir, whole)))
        return build_index(corpus)

    return _stored(spark, sf_dir, "support_index whole" if whole else "support_index", build)


def document_index(spark: SparkSession, sf_dir: str) -> TfidfIndex:
    """An index over the given documents, exact copies included."""
    # Texts are shuffled by the index itself before they are worked on.
    return _stored(
        spark, sf_dir, "document_index",
        lambda: build_index(
            read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id"
        ),
    )


def triaged(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Every message triaged against the index; its cases are stored by their ids."""
    index = support_index(spark, sf_dir, whole)
    return _stored(
        spark, sf_dir, "triaged whole" if whole else "triaged",
        lambda: settle(spark, lambda: case_ids(triage(messages(spark, sf_dir, whole), index))),
    )


def triaged_with_cases(
    spark: SparkSession, sf_dir: str,
    columns: tuple[str, ...] = ("initial_query", "first_support_reply"), whole: bool = False,
) -> DataFrame:
    """The same with columns of the cases, which are read from the index and not stored."""
    return with_cases(triaged(spark, sf_dir, whole), support_index(spark, sf_dir, whole), columns)


def triaged_with_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole dialogues in the evidence, for prompts."""
    columns = ("initial_query", "first_support_reply", "full_dialogue")
    return triaged_with_cases(spark, sf_dir, columns)
