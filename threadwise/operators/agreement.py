"""Agreement between human ratings and judge scores.

Scores are whole numbers from 1 to 5, so each dimension reduces to at most 25 (human, judge)
cells; every statistic, ranks included, is computed from the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwise.operators.golden import missing_columns, violation_rows
from threadwise.rules import fixed_values as fixed
from threadwise.sources.schemas import DIMENSIONS

REQUIRED = ("conversation_id", *DIMENSIONS)
FLAT = 1e-9


def repeated_ids(ratings: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, rows) for ids that occur more than once."""
    return ratings.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def invalid_dimensions(
    ratings: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS
) -> DataFrame:
    """(dimension, invalid): dimensions with a score that is no whole number from 1 to 5."""

    def invalid(name: str) -> Column:
        number = F.col(name).cast("string").try_cast("double")
        good = number.between(1, 5) & (number % 1 == 0)
        return ~F.coalesce(good, F.lit(False))

    counts = ratings.agg(*[F.count_if(invalid(name)).alias(name) for name in dimensions])
    return counts.unpivot([], list(dimensions), "dimension", "invalid").where("invalid > 0")


def unknown_ids(
    ratings: DataFrame, results: DataFrame, key: str = "conversation_id"
) -> DataFrame:
    """Rated ids that the results do not contain."""
    return (
        ratings.select(F.col(key).cast("string"))
        .distinct()
        .join(results.select(F.col(key).cast("string")), key, "left_anti")
    )


def rating_violations(
    ratings: DataFrame,
    results: DataFrame | None = None,
    absent: list[str] | tuple[str, ...] = (),
    key: str = "conversation_id",
) -> DataFrame:
    """(check, subject, rows): everything that is wrong with ratings, instead of the first error.

    ``absent`` are columns that the file of the ratings lacks; reading it leaves them null, and no
    further check looks at them. A table without rows, an id rated more than once, an id that the
    results don't know and a dimension with invalid scores are one row each.
    """
    spark = ratings.sparkSession
    lacking = sorted(set(absent) | set(missing_columns(ratings, REQUIRED)))
    found = violation_rows(spark, "missing_column", lacking)
    empty = ratings.agg(F.count("*").alias("n")).where("n = 0")
    found = found.unionByName(
        empty.select(
            F.lit("empty").alias("check"), F.lit(None).cast("string").alias("subject"),
            F.lit(0).cast("long").alias("rows"),
        )
    )
    dimensions = tuple(name for name in DIMENSIONS if name not in lacking)
    if dimensions:
        found = found.unionByName(
            invalid_dimensions(ratings, dimensions).select(
                F.lit("invalid_score").alias("check"), F.col("dimension").alias("subject"),
                F.col("invalid").alias("rows"),
            )
        )
    if key not in lacking:
        subject = F.col(key).cast("string").alias("subject")
        found = found.unionByName(
            repeated_ids(ratings, key).select(F.lit("repeated_id").alias("check"), subject, "rows")
        )
        if results is not None:
            found = found.unionByName(
                unknown_ids(ratings, results, key).select(
                    F.lit("unknown_id").alias("check"), subject, F.lit(1).cast("long").alias("rows")
                )
            )
    return found


def validate_ratings(
    ratings: DataFrame, results: DataFrame | None = None, key: str = "conversation_id"
) -> None:
    """Raise ValueError on the first broken check."""
    missing = missing_columns(ratings, REQUIRED)
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    if ratings.isEmpty():
        raise ValueError("the ratings hold no rows")
    if not repeated_ids(ratings, key).isEmpty():
        raise ValueError("conversation_id values must be unique")
    bad = [row["dimension"] for row in invalid_dimensions(ratings).collect()]
    if bad:
        raise ValueError(
            "every rating must be a whole number from 1 to 5; check " + ", ".join(sorted(bad))
        )
    if results is not None:
        first = unknown_ids(ratings, results, key).orderBy(key).limit(5).collect()
        if first:
            raise ValueError(
                "rated ids missing from the results: " + ", ".join(row[0] for row in first)
            )


def join_ratings(
    results: DataFrame, ratings: DataFrame, key: str = "conversation_id"
) -> DataFrame:
    """Results and ratings side by side; shared columns get ``_judge`` and ``_human``."""
    shared = [c for c in ratings.columns if c in results.columns and c != key]
    left = results.withColumnsRenamed({c: f"{c}_judge" for c in shared})
    right = ratings.withColumnsRenamed({c: f"{c}_human" for c in shared})
    return left.join(right, key)


def long_scores(joined: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimension, human, judge): dimensions missing on either side are skipped."""
    present = [d for d in dimensions if d in joined.columns and f"judge_{d}" in joined.columns]
    pairs = [
        F.struct(
            F.lit(d).alias("dimension"),
            F.col(d).cast("double").alias("human"),
            F.col(f"judge_{d}").cast("double").alias("judge"),
        )
        for d in present
    ]
    return joined.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def score_cells(scores: DataFrame) -> DataFrame:
    """(dimension, human, judge, n)."""
    return scores.groupBy("dimension", "human", "judge").agg(F.count("*").alias("n"))


def _average_ranks(cells: DataFrame, side: str) -> DataFrame:
    """(dimension, side, <side>_rank): ties share the mean of their positions."""
    values = cells.groupBy("dimension", side).agg(F.sum("n").alias("ties"))
    upto = F.sum("ties").over(Window.partitionBy("dimension").orderBy(side))
    return values.select(
        "dimension", side, (upto - (F.col("ties") - 1) / 2).alias(f"{side}_rank")
    )


def _correlation(x: str, y: str) -> Column:
    """Pearson correlation of weighted cells; 0 where either side is constant."""
    n = F.sum("n")
    mean_x, mean_y = F.sum(F.col(x) * F.col("n")) / n, F.sum(F.col(y) * F.col("n")) / n
    cov = F.sum(F.col(x) * F.col(y) * F.col("n")) / n - mean_x * mean_y
    var_x = F.sum(F.col(x) * F.col(x) * F.col("n")) / n - mean_x * mean_x
    var_y = F.sum(F.col(y) * F.col(y) * F.col("n")) / n - mean_y * mean_y
    std_x, std_y = F.sqrt(F.greatest(var_x, F.lit(0.0))), F.sqrt(F.greatest(var_y, F.lit(0.0)))
    return F.when((std_x < FLAT) | (std_y < FLAT), 0.0).otherwise(
        F.try_divide(cov, std_x * std_y)
    )


def agreement(scores: DataFrame, tolerance: int = 1) -> DataFrame:
    """Per dimension: share within tolerance, both correlations, mean error, sample size."""
    cells = score_cells(scores)
    ranked = cells.join(_average_ranks(cells, "human"), ["dimension", "human"]).join(
        _average_ranks(cells, "judge"), ["dimension", "judge"]
    )
    gap = F.abs(F.col("human") - F.col("judge"))
    n = F.sum("n")
    return ranked.groupBy("dimension").agg(
        F.round(
            100 * F.sum(F.when(gap <= tolerance, F.col("n")).otherwise(0)) / n, 2
        ).alias("percentage_agreement"),
        F.round(_correlation("human", "judge"), 4).alias("pearson_r"),
        F.round(_correlation("human_rank", "judge_rank"), 4).alias("spearman_r"),
        F.round(F.sum(gap * F.col("n")) / n, 4).alias("mean_abs_error"),
        n.alias("n_samples"),
    )


def rating_template(
    results: DataFrame, n: int = fixed.RATING_TEMPLATE_ROWS, key: str = "conversation_id"
) -> DataFrame:
    """The first ``n`` results with blank scores for a person to fill in."""
    return (
        results.orderBy(key)
        .limit(n)
        .select(key, "message", "reply", *[F.lit("").alias(d) for d in DIMENSIONS])
    )
