"""Reply scoring and the evaluation result tables built on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.functions.text import shorten
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.sources.schemas import DIMENSIONS

JUDGE_COLUMNS = [f"judge_{name}" for name in DIMENSIONS]
LOW_QUALITY = 3.0
EVIDENCE_CUT = 100


def marker_hits(lowered: Column, markers: tuple[str, ...]) -> Column:
    """How many markers occur as plain substrings."""
    hits = [F.contains(lowered, F.lit(marker)).cast("int") for marker in markers]
    return reduce(lambda a, b: a + b, hits)


def heuristic_scores(results: DataFrame, reply: str = "reply") -> DataFrame:
    """Add the five judge scores and the reasoning from markers in the reply.

    ``evidence`` may be an array of cases or its JSON text.
    """
    kind = results.schema["evidence"].dataType.typeName()
    has_evidence = (
        F.size("evidence") > 0
        if kind == "array"
        else F.coalesce(F.json_array_length("evidence"), F.lit(0)) > 0
    )
    lowered = F.lower(F.coalesce(F.col(reply), F.lit("")))
    return results.withColumns(
        {
            "judge_correctness": F.lit(3),
            "judge_groundedness": F.when(has_evidence, 3).otherwise(2),
            "judge_helpfulness": F.least(
                2 + marker_hits(lowered, fixed.ACTION_MARKERS), F.lit(5)
            ),
            "judge_tone": F.least(3 + marker_hits(lowered, fixed.EMPATHY_MARKERS), F.lit(5)),
            "judge_hallucination": F.greatest(
                5 - marker_hits(lowered, fixed.PROMISE_MARKERS), F.lit(2)
            ),
            "judge_reasoning": F.lit(wording.JUDGE_REASONING),
        }
    )


def mean_scores(judged: DataFrame) -> DataFrame:
    """(dimension, mean): three places, 0.0 for an empty table."""
    means = judged.agg(
        *[
            F.round(F.coalesce(F.avg(f"judge_{name}"), F.lit(0.0)), 3).alias(name)
            for name in DIMENSIONS
        ]
    )
    return means.unpivot([], list(DIMENSIONS), "dimension", "mean")


def evidence_json(evidence: Column) -> Column:
    """Compact JSON of the evidence: shortened query and score per case."""
    return F.to_json(
        F.transform(
            evidence,
            lambda case: F.struct(
                shorten(F.coalesce(case["initial_query"], F.lit("")), EVIDENCE_CUT).alias("query"),
                case["similarity_score"].alias("score"),
            ),
        )
    )


def agent_results(triaged: DataFrame, text: str = "message") -> DataFrame:
    """Triaged golden rows as an evaluation table, predictions beside the truth.

    Needs the golden columns renamed to ``true_intent`` and ``true_action``.
    """
    return triaged.select(
        "conversation_id",
        F.col(text).alias("message"),
        "true_intent",
        F.col("intent").alias("pred_intent"),
        "confidence",
        "true_action",
        F.col("escalation.decision").alias("pred_action"),
        F.col("escalation.reason").alias("escalation_reason"),
        "reply",
        "reply_grounded",
        "historical_grounded",
        "answer_supported",
        "support_reason",
        "grounding_reason",
        "generation_model",
        evidence_json(F.col("evidence")).alias("evidence"),
    )


def with_mean_score(judged: DataFrame) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(name) for name in JUDGE_COLUMNS])
    return judged.withColumn("avg_judge_score", total / len(JUDGE_COLUMNS))


WRONG_INTENT = "true_intent <> pred_intent"
WRONG_ACTION = "true_action <> pred_action"
LOW_SCORE = f"avg_judge_score < {LOW_QUALITY}"


def intent_failures(judged: DataFrame) -> DataFrame:
    return judged.where(WRONG_INTENT)


def escalation_failures(judged: DataFrame) -> DataFrame:
    return judged.where(WRONG_ACTION)


def low_quality(judged: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Rows with a mean score below the limit, worst first, equal scores by key."""
    return with_mean_score(judged).where(LOW_SCORE).orderBy("avg_judge_score", key)


def any_failure(judged: DataFrame) -> DataFrame:
    return with_mean_score(judged).where(f"{WRONG_INTENT} OR {WRONG_ACTION} OR {LOW_SCORE}")


def failure_counts(judged: DataFrame) -> DataFrame:
    wrong_intent, wrong_action, low = F.expr(WRONG_INTENT), F.expr(WRONG_ACTION), F.expr(LOW_SCORE)
    return with_mean_score(judged).agg(
        F.count_if(wrong_intent).alias("intent_failures"),
        F.count_if(wrong_action).alias("escalation_failures"),
        F.count_if(low).alias("low_quality"),
        F.count_if(wrong_intent | wrong_action | low).alias("any_failure"),
    )
