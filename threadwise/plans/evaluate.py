"""Evaluation: baselines and triage against a reviewed set, reply scores and failure tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.operators.agreement import agreement, join_ratings, long_scores, validate_ratings
from threadwise.operators.baselines import fit_text_classifier, predict_majority
from threadwise.operators.golden import bounded_sample
from threadwise.operators.intent import weak_label
from threadwise.operators.metrics import (
    binary_counts,
    binary_scores,
    class_report,
    confusion,
    model_comparison,
)
from threadwise.operators.quality import (
    agent_results,
    any_failure,
    escalation_failures,
    heuristic_scores,
    intent_failures,
    low_quality,
    mean_scores,
)
from threadwise.operators.tfidf import TfidfIndex
from threadwise.plans.triage import triage
from threadwise.rules import fixed_values as fixed
from threadwise.rules.pack import SUPPORT_PACK, RulePack
from threadwise.session import cut_lineage
from threadwise.sources.tables import write_flat, write_nested

MAJORITY, LINEAR, AGENT = "Majority Class", "TF-IDF + LogReg", "Agent"


def run_agent(
    golden: DataFrame, index: TfidfIndex, k: int = fixed.AGENT_TOP_K,
    pack: RulePack = SUPPORT_PACK,
) -> DataFrame:
    """Triage golden messages and lay predictions beside the truth."""
    messages = golden.select(
        "conversation_id",
        "message",
        F.col("intent").alias("true_intent"),
        F.col("expected_action").alias("true_action"),
    )
    return agent_results(triage(messages, index, "conversation_id", "message", k, pack))


def training_rows(
    conversations: DataFrame, n: int = fixed.TRAINING_ROWS, pack: RulePack = SUPPORT_PACK,
    exclude_ids: DataFrame | None = None,
) -> DataFrame:
    """(conversation_id, message, label): weakly labelled rows to fit the baselines on."""
    drawn = bounded_sample(
        conversations.where("initial_query IS NOT NULL"), n, exclude_ids=exclude_ids
    )
    named = drawn.select("conversation_id", F.col("initial_query").alias("message"))
    return weak_label(named, "message", "label", pack)


def baseline_predictions(golden: DataFrame, training: DataFrame) -> dict[str, DataFrame]:
    """Golden rows with ``predicted`` for each baseline."""
    linear = fit_text_classifier(training, "conversation_id")
    return {
        MAJORITY: predict_majority(golden, training),
        LINEAR: golden.join(linear.predict(golden, "conversation_id"), "conversation_id"),
    }


@dataclass
class Evaluation:
    judged: DataFrame
    comparison: DataFrame
    reports: dict[str, DataFrame]
    escalation: DataFrame
    reply_quality: DataFrame

    def summary(self) -> DataFrame:
        """One nested row with every figure, for a JSON file."""
        models = self.comparison.agg(
            F.sort_array(F.collect_list(F.struct(*self.comparison.columns))).alias("models")
        )
        quality = self.reply_quality.agg(
            F.sort_array(F.collect_list(F.struct("dimension", "mean"))).alias("reply_quality")
        )
        escalation = self.escalation.agg(
            F.first(F.struct(*self.escalation.columns)).alias("escalation")
        )
        # Three tables of one row each.
        return (
            models.withColumn("escalation", escalation.scalar())
            .withColumn("reply_quality", quality.scalar())
        )

    def write(self, folder: str, fmt: str = "csv") -> None:
        write_flat(self.judged, f"{folder}/judged_results", fmt)
        write_flat(self.comparison, f"{folder}/baseline_results", fmt)
        write_flat(intent_failures(self.judged), f"{folder}/intent_failures", fmt)
        write_flat(escalation_failures(self.judged), f"{folder}/escalation_failures", fmt)
        write_flat(low_quality(self.judged), f"{folder}/low_quality_replies", fmt)
        write_flat(any_failure(self.judged), f"{folder}/failures", fmt)
        for name, report in self.reports.items():
            slug = "".join(ch if ch.isalnum() else "_" for ch in name.lower())
            write_flat(report, f"{folder}/class_report_{slug}", fmt)
        write_nested(self.summary(), f"{folder}/evaluation_summary")


def summary_rows(document: DataFrame) -> DataFrame:
    """(path, value): every number of a nested document, as read from its JSON file.

    A path is made of the names of the fields; an element of an array goes by its first text field.
    """
    found = [_numbers(field.dataType, F.col(field.name), F.lit(field.name)) for field in document.schema]
    return document.select(F.inline(F.concat(*found)))


def _numbers(kind: T.DataType, value: Column, path: Column) -> Column:
    if isinstance(kind, T.StructType):
        parts = [
            _numbers(field.dataType, value[field.name], F.concat(path, F.lit(f".{field.name}")))
            for field in kind
        ]
        return F.concat(*parts)
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        named = [f.name for f in element if isinstance(f.dataType, T.StringType)][0]
        return F.flatten(
            F.transform(
                value, lambda e: _numbers(element, e, F.concat(path, F.lit("."), e[named]))
            )
        )
    number = F.struct(path.alias("path"), value.try_cast("double").alias("value"))
    return F.array(number) if isinstance(kind, T.NumericType) else F.slice(F.array(number), 1, 0)


def evaluate(
    golden: DataFrame,
    conversations: DataFrame,
    index: TfidfIndex,
    pack: RulePack = SUPPORT_PACK,
    training: int = fixed.TRAINING_ROWS,
) -> Evaluation:
    judged = cut_lineage(heuristic_scores(run_agent(golden, index, pack=pack)))
    predictions = baseline_predictions(golden, training_rows(conversations, training, pack))
    cells = {
        name: confusion(rows, "intent", "predicted") for name, rows in predictions.items()
    }
    return evaluation_of(judged, cells | {AGENT: confusion(judged, "true_intent", "pred_intent")})


def evaluation_of(judged: DataFrame, cells: dict[str, DataFrame]) -> Evaluation:
    """All tables of an evaluation from judged rows and a confusion table per model."""
    cells = {name: cut_lineage(table) for name, table in cells.items()}
    actions = cut_lineage(confusion(judged, "true_action", "pred_action"))
    counts = binary_counts(actions)
    escalation = binary_scores(actions).withColumns(
        {c: counts.select(c).scalar() for c in counts.columns}
    )
    return Evaluation(
        judged,
        model_comparison(cells),
        {name: class_report(table) for name, table in cells.items()},
        escalation,
        mean_scores(judged),
    )


def rate_agreement(results: DataFrame, ratings: DataFrame) -> DataFrame:
    """Validate the ratings, then compare them with the judge dimension by dimension."""
    validate_ratings(ratings, results)
    return agreement(long_scores(join_ratings(results, ratings)))
