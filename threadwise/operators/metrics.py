"""Classification metrics, all derived from one confusion table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def _places(column: Column, name: str) -> Column:
    return F.round(column, 4).alias(name)


def confusion(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n): the only pass over the data that the metrics need."""
    return predictions.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def accuracy(cells: DataFrame) -> DataFrame:
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    return cells.agg(_places(_ratio(F.sum(hit), F.sum("n")), "accuracy"))


def label_scores(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) unrounded, for labels in truth or prediction."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")

    def entry(label: str, tp: Column, support: Column, claimed: Column) -> Column:
        return F.struct(
            F.col(label).alias("label"), tp.alias("tp"), support.alias("support"),
            claimed.alias("claimed"),
        )

    # Each cell counts once for its true label and once for its predicted label.
    both = F.array(
        entry("truth", hit.cast("long"), F.col("n"), none),
        entry("predicted", none, none, F.col("n")),
    )
    sums = cells.select(F.inline(both)).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("claimed").alias("claimed"),
    )
    return sums.select(
        "label",
        _ratio(F.col("tp"), F.col("claimed")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
    )


def macro_scores(cells: DataFrame) -> DataFrame:
    return label_scores(cells).agg(
        _places(F.avg("precision"), "macro_precision"),
        _places(F.avg("recall"), "macro_recall"),
        _places(F.avg("f1"), "macro_f1"),
    )


def _weighted(name: str) -> Column:
    return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))


def weighted_scores(cells: DataFrame) -> DataFrame:
    return label_scores(cells).agg(
        _places(_weighted("precision"), "weighted_precision"),
        _places(_weighted("recall"), "weighted_recall"),
        _places(_weighted("f1"), "weighted_f1"),
    )


def class_report(cells: DataFrame) -> DataFrame:
    """Per-label scores followed by macro, weighted and accuracy rows."""
    scores = label_scores(cells)
    rows = scores.select(
        "label", _places(F.col("precision"), "precision"), _places(F.col("recall"), "recall"),
        _places(F.col("f1"), "f1"), "support",
    )
    macro = scores.agg(
        F.lit("macro avg").alias("label"),
        _places(F.avg("precision"), "precision"), _places(F.avg("recall"), "recall"),
        _places(F.avg("f1"), "f1"), F.sum("support").alias("support"),
    )
    weighted = scores.agg(
        F.lit("weighted avg").alias("label"),
        _places(_weighted("precision"), "precision"), _places(_weighted("recall"), "recall"),
        _places(_weighted("f1"), "f1"), F.sum("support").alias("support"),
    )
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    exact = cells.agg(
        F.lit("accuracy").alias("label"),
        *[_places(_ratio(F.sum(hit), F.sum("n")), name) for name in ("precision", "recall", "f1")],
        F.sum("n").alias("support"),
    )
    return rows.union(macro).union(weighted).union(exact)


def intent_metrics(cells: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1, macro precision, macro recall, weighted F1."""
    hit = F.sum("recall_hits")
    scores = label_scores(cells).withColumn("recall_hits", F.col("recall") * F.col("support"))
    return scores.agg(
        _places(_ratio(hit, F.sum("support")), "accuracy"),
        _places(F.avg("f1"), "macro_f1"),
        _places(F.avg("precision"), "macro_precision"),
        _places(F.avg("recall"), "macro_recall"),
        _places(_weighted("f1"), "weighted_f1"),
    )


def _cell(truth: bool, predicted: bool, positive: str) -> Column:
    is_truth = F.col("truth") == positive
    is_predicted = F.col("predicted") == positive
    condition = (is_truth if truth else ~is_truth) & (is_predicted if predicted else ~is_predicted)
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def binary_counts(cells: DataFrame, positive: str = "ESCALATE") -> DataFrame:
    return cells.agg(
        _cell(True, True, positive).alias("true_positives"),
        _cell(False, True, positive).alias("false_positives"),
        _cell(True, False, positive).alias("false_negatives"),
        _cell(False, False, positive).alias("true_negatives"),
    )


def binary_scores(cells: DataFrame, positive: str = "ESCALATE") -> DataFrame:
    """One row: precision, recall and F1 of ``positive``."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return binary_counts(cells, positive).select(
        _places(_ratio(tp, tp + fp), "precision"),
        _places(_ratio(tp, tp + fn), "recall"),
        _places(_ratio(2 * tp, 2 * tp + fp + fn), "f1"),
    )


def model_comparison(models: dict[str, DataFrame]) -> DataFrame:
    """(model, intent metrics): one row per named confusion table."""
    rows = [
        intent_metrics(cells).select(F.lit(name).alias("model"), "*")
        for name, cells in models.items()
    ]
    table = rows[0]
    for row in rows[1:]:
        table = table.unionByName(row)
    return table
