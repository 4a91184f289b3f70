"""Triage: classify, retrieve, draft, ground and route a whole table of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.functions.text import shorten
from threadwise.operators.intent import classify, display_label
from threadwise.operators.replies import generate_replies
from threadwise.operators.routing import AUTO, RoutingPolicy, route
from threadwise.operators.similarity import attach_evidence
from threadwise.operators.tfidf import TfidfIndex
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK, RulePack

REPORT_CASES = 3
REPORT_CUT = 180


def triage(
    messages: DataFrame,
    index: TfidfIndex,
    key: str = "msg_id",
    text: str = "message",
    k: int = fixed.AGENT_TOP_K,
    pack: RulePack = SUPPORT_PACK,
    policy: RoutingPolicy = RoutingPolicy(),
    columns: tuple[str, ...] = ("initial_query", "first_support_reply"),
) -> DataFrame:
    """One wide row per message with intent, evidence, reply, grounding and escalation."""
    if k < 1:
        raise ValueError("k must be at least 1")
    with_evidence = attach_evidence(messages, index, key, text, k, columns=columns)
    drafted = generate_replies(classify(with_evidence, text, pack), text, pack)
    return route(drafted.withColumn("reply_grounded", F.col("grounded")), text, pack, policy)


def triage_message(message: str, index: TfidfIndex, **options) -> DataFrame:
    """The result row of a single message."""
    spark = index.postings.sparkSession
    return triage(spark.createDataFrame([(0, message)], "msg_id long, message string"), index, **options)


def triage_report(
    results: DataFrame, key: str = "msg_id", text: str = "message", pack: RulePack = SUPPORT_PACK
) -> DataFrame:
    """The columns a reader of one result wants, as text-ready values."""
    basic = (F.col("intent") == "device_hardware_issue") & (
        F.col("escalation.decision") == AUTO
    )
    cases = F.transform(
        F.slice("evidence", 1, REPORT_CASES),
        lambda case: F.concat(
            F.lit("Customer: "),
            shorten(F.coalesce(case["initial_query"], F.lit("")), REPORT_CUT),
            F.lit("\nSupport: "),
            shorten(F.coalesce(case["first_support_reply"], F.lit("")), REPORT_CUT),
        ),
    )
    return display_label(results, text, pack).select(
        key,
        text,
        "display_label",
        "confidence",
        F.size("evidence").alias("evidence_count"),
        F.round("best_similarity", 3).alias("top_similarity"),
        F.replace(F.col("escalation.decision"), F.lit("_"), F.lit("-")).alias("decision"),
        F.when(basic, wording.REPORT_HARDWARE_REASON)
        .otherwise(F.col("escalation.reason"))
        .alias("reason"),
        "reply",
        "historical_grounded",
        "grounding_reason",
        "answer_supported",
        "support_reason",
        F.when(F.size("evidence") > 0, F.array_join(cases, "\n"))
        .otherwise(F.lit("No past case was retrieved."))
        .alias("evidence_text"),
    )
