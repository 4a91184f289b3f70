"""Evaluation sets: weakly labelled, stratified, validated."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwise.operators.intent import first_match, weak_label
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK, RulePack
from threadwise.session import cut_lineage

REQUIRED = (
    "conversation_id", "message", "intent", "expected_action", "label_source", "review_status",
)
# Up to this quota Spark cuts the rows of a ranking before its shuffle.
WINDOW_QUOTA = 1000
# A random order keyed by the id: the same rows are drawn in every run and on every engine.


def draw_order(key: str, seed: int = fixed.SEED) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


def eligible_queries(
    conversations: DataFrame, text: str = "initial_query",
    min_length: int = fixed.GOLDEN_MIN_QUERY_LENGTH,
) -> DataFrame:
    return conversations.where(F.length(text) > min_length)


def quotas(total: int = fixed.GOLDEN_TOTAL, pack: RulePack = SUPPORT_PACK) -> dict[str, int]:
    """Even shares; the first intents take the remainder."""
    share, extra = divmod(total, len(pack.intents))
    return {name: share + (i < extra) for i, name in enumerate(pack.intent_names)}


def quota_column(intent: Column, shares: dict[str, int]) -> Column:
    cases = [(intent == name, F.lit(share)) for name, share in shares.items()]
    return first_match(cases, F.lit(0))


def quota_table(
    labelled: DataFrame, label: str = "weak_label", total: int = fixed.GOLDEN_TOTAL,
    pack: RulePack = SUPPORT_PACK,
) -> DataFrame:
    """(intent, quota, available, drawn) for the intents present."""
    shares = quotas(total, pack)
    return (
        labelled.groupBy(F.col(label).alias("intent"))
        .agg(F.count("*").alias("available"))
        .withColumn("quota", quota_column(F.col("intent"), shares))
        .withColumn("drawn", F.least("available", "quota"))
    )


def stratified_sample(
    labelled: DataFrame, key: str = "conversation_id", label: str = "weak_label",
    total: int = fixed.GOLDEN_TOTAL, seed: int = fixed.SEED, pack: RulePack = SUPPORT_PACK,
) -> DataFrame:
    """At most the quota of rows per intent, drawn in hash order."""
    shares = quotas(total, pack)
    if max(shares.values()) > WINDOW_QUOTA:
        return histogram_sample(labelled, shares, key, label, seed)
    order = Window.partitionBy(label).orderBy(draw_order(key, seed), F.col(key))
    # The constant limit lets every task drop rows before the shuffle, however large an intent is.
    return (
        labelled.withColumn("_draw", F.row_number().over(order))
        .where(F.col("_draw") <= max(shares.values()))
        .where(F.col("_draw") <= quota_column(F.col(label), shares))
        .drop("_draw")
    )


def histogram_sample(
    labelled: DataFrame, shares: dict[str, int], key: str = "conversation_id",
    label: str = "weak_label", seed: int = fixed.SEED,
) -> DataFrame:
    """The rows of ``stratified_sample`` for quotas of any size.

    A histogram of the heads of the hashes gives every label the head that completes its quota.
    Rows of smaller heads are drawn as they are; only those of that one head, about one in 65,536
    of a label, are put in order.
    """
    wanted = [F.col(label) == name for name, share in shares.items() if share > 0]
    keyed = labelled.where(reduce(or_, wanted)) if wanted else labelled.where("false")
    # Read three times: once for the histogram, twice for the rows.
    keyed = cut_lineage(keyed.withColumn("_draw", draw_order(key, seed)))
    keyed = keyed.withColumn("_head", F.substring("_draw", 1, 4))
    counts = keyed.groupBy(label, "_head").agg(F.count("*").alias("rows"))
    # At most 65,536 heads per label, so each window is small by construction.
    reached = counts.withColumn(
        "so_far", F.sum("rows").over(Window.partitionBy(label).orderBy("_head"))
    ).withColumn("quota", quota_column(F.col(label), shares))
    full = F.col("so_far") >= F.col("quota")
    limits = reached.groupBy(label).agg(
        F.min(F.when(full, F.col("_head"))).alias("_last"),
        (
            F.max("quota") - F.coalesce(F.max(F.when(~full, F.col("so_far"))), F.lit(0))
        ).alias("_left"),
    )
    # One row per label of the pack.
    dealt = keyed.join(F.broadcast(limits), label)
    whole = dealt.where(F.col("_last").isNull() | (F.col("_head") < F.col("_last")))
    order = Window.partitionBy(label).orderBy("_draw", key)
    partly = (
        dealt.where(F.col("_head") == F.col("_last"))
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= F.col("_left"))
    )
    return whole.select(labelled.columns).unionByName(partly.select(labelled.columns))


def golden_set(
    conversations: DataFrame, total: int = fixed.GOLDEN_TOTAL, seed: int = fixed.SEED,
    pack: RulePack = SUPPORT_PACK,
) -> DataFrame:
    """Candidates for an evaluation set, ready for review by a person."""
    labelled = weak_label(eligible_queries(conversations), "initial_query", pack=pack)
    drawn = stratified_sample(labelled, total=total, seed=seed, pack=pack)
    action = first_match(
        [(F.col("weak_label") == x.name, F.lit(x.default_action)) for x in pack.intents],
        F.lit(None).cast("string"),
    )
    return drawn.select(
        "conversation_id",
        F.col("initial_query").alias("message"),
        F.col("weak_label").alias("intent"),
        action.alias("expected_action"),
        "first_support_reply",
        F.lit(wording.GOLDEN_LABEL_SOURCE).alias("label_source"),
        F.lit(wording.GOLDEN_REVIEW_STATUS).alias("review_status"),
        F.lit(wording.GOLDEN_NOTES).alias("notes"),
    )


def intent_breakdown(golden: DataFrame) -> DataFrame:
    """(intent, rows), most rows first."""
    counted = golden.groupBy("intent").agg(F.count("*").alias("rows"))
    return counted.orderBy(F.desc("rows"), "intent")


def golden_checks(
    golden: DataFrame, row_range: tuple[int, int] = fixed.GOLDEN_ROW_RANGE,
    pack: RulePack = SUPPORT_PACK,
) -> DataFrame:
    """(check, value, violations), all checks in one aggregation over rows grouped by id."""
    low, high = row_range
    bad_intent = ~F.coalesce(F.col("intent").isin(*pack.intent_names), F.lit(False))
    bad_action = ~F.coalesce(F.col("expected_action").isin("AUTO_HANDLE", "ESCALATE"), F.lit(False))
    pending = ~F.coalesce(F.col("review_status") == "reviewed", F.lit(False))
    per_id = golden.groupBy("conversation_id").agg(
        F.count("*").alias("rows"),
        F.count_if(bad_intent).alias("bad_intent"),
        F.count_if(bad_action).alias("bad_action"),
        F.count_if(pending).alias("pending"),
    )
    totals = per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeats"),
        F.coalesce(F.sum("bad_intent"), F.lit(0)).alias("bad_intent"),
        F.coalesce(F.sum("bad_action"), F.lit(0)).alias("bad_action"),
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"),
    )
    size = F.col("rows")
    checks = [
        ("row_count", size, F.when(size.between(low, high), 0).otherwise(1)),
        ("unique_id", size - F.col("repeats"), F.col("repeats")),
        ("known_intent", size - F.col("bad_intent"), F.col("bad_intent")),
        ("known_action", size - F.col("bad_action"), F.col("bad_action")),
        ("reviewed", size - F.col("pending"), F.col("pending")),
    ]
    entries = [
        F.struct(
            F.lit(name).alias("check"),
            value.cast("long").alias("value"),
            violations.cast("long").alias("violations"),
        )
        for name, value, violations in checks
    ]
    distinct_intents = golden.agg(
        F.lit("distinct_intents").alias("check"),
        F.count_distinct("intent").alias("value"),
        F.lit(0).cast("long").alias("violations"),
    )
    return totals.select(F.explode(F.array(*entries)).alias("c")).select("c.*").union(distinct_intents)


def missing_columns(df: DataFrame, required: tuple[str, ...] | list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


MESSAGES = {
    "row_count": "the row count is outside the allowed range",
    "unique_id": "conversation_id values must be unique",
    "known_intent": "an intent is outside the taxonomy",
    "known_action": "expected_action must be AUTO_HANDLE or ESCALATE",
    "reviewed": "rows still need manual review",
}


def golden_violations(
    golden: DataFrame, absent: list[str] | tuple[str, ...] = (),
    row_range: tuple[int, int] = fixed.GOLDEN_ROW_RANGE, pack: RulePack = SUPPORT_PACK,
) -> DataFrame:
    """(check, subject, rows): everything that is wrong with a set, instead of the first error.

    ``absent`` are columns that its file lacks; reading it leaves them null.
    """
    missing = violation_rows(golden.sparkSession, "missing_column", absent)
    found = golden_checks(golden, row_range, pack).where("violations > 0")
    return missing.unionByName(
        found.select("check", F.lit(None).cast("string").alias("subject"),
                     F.col("violations").alias("rows"))
    )


def violation_rows(spark: SparkSession, check: str, subjects) -> DataFrame:
    """(check, subject, rows) for names known without reading a table."""
    names = F.array(*[F.lit(name) for name in subjects]).cast("array<string>")
    return spark.range(1).select(
        F.lit(check).alias("check"), F.explode(names).alias("subject"), F.lit(0).cast("long").alias("rows")
    )


def validate_golden(
    golden: DataFrame, require_reviewed: bool = False,
    row_range: tuple[int, int] = fixed.GOLDEN_ROW_RANGE, pack: RulePack = SUPPORT_PACK,
) -> dict[str, int]:
    """Raise ValueError on the first broken check; return pending rows and distinct intents."""
    missing = missing_columns(golden, REQUIRED)
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    # A fixed handful of rows, one per check.
    found = {row["check"]: row for row in golden_checks(golden, row_range, pack).collect()}
    for check, message in MESSAGES.items():
        if check == "reviewed" and not require_reviewed:
            continue
        if found[check]["violations"]:
            raise ValueError(f"{message} ({found[check]['violations']})")
    return {
        "rows": found["row_count"]["value"],
        "intents": found["distinct_intents"]["value"],
        "pending": found["reviewed"]["violations"],
    }


def bounded_sample(
    rows: DataFrame, n: int = fixed.TRAINING_ROWS, key: str = "conversation_id",
    seed: int = fixed.SEED, exclude_ids: DataFrame | None = None,
) -> DataFrame:
    """``n`` rows (all, if fewer) in hash order; ``exclude_ids`` are never drawn.

    Rows are counted by the head of their hash, and only those up to the head that completes ``n``
    are sorted.
    """
    if exclude_ids is not None:
        rows = rows.join(exclude_ids.select(key), key, "left_anti")
    keyed = rows.withColumn("_draw", draw_order(key, seed))
    head = F.substring("_draw", 1, 4)
    # At most 65,536 heads, so this window is small by construction.
    reached = keyed.groupBy(head.alias("head")).agg(F.count("*").alias("rows")).withColumn(
        "so_far", F.sum("rows").over(Window.orderBy("head"))
    )
    last = reached.agg(
        F.coalesce(F.min(F.when(F.col("so_far") >= n, F.col("head"))), F.lit("ffff")).alias("last")
    )
    return keyed.where(head <= last.scalar()).orderBy("_draw", key).limit(n).drop("_draw")
