"""Mixing sources to target weights by weighted fair queueing.

Every source puts its documents in a shuffled order and repeats that order up to ``max_repeats``
times. A document's virtual finish time is the number of its source's words up to and including
it, divided by the source's target. The mix is the prefix, by finish time over all sources, whose
words fit the budget, so each source stops near its target.

Defined results: null text has size 0; null source is a source of its own, last in order; documents
of size 0 are never taken; equal rows are interchangeable and each keeps its own turns; an empty
table gives an empty table. Input columns named like a column the operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadwise.llm.common import drop_columns, set_aside, whole_text, word_count
from threadwise.session import cut_lineage

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
# Ranges of finish time up to 1, where sources reach their targets, and parts of each range. They
# only keep what is sorted in one task small; the result does not depend on them.
RANGES = 4096
# Hex digits of the shuffled order that split a source into parts of a running sum.
PART_DIGITS = 3

ADDED = (
    "size", "source_size", "target", "taken",
    "mix_order", "mix_source", "mix_part", "mix_end", "mix_turn",
)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``size`` in words and ``mix_order``, a shuffled order that reruns repeat."""
    whole = whole_text(text)
    order = F.md5(
        F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(whole))
    )
    return drop_columns(docs, *ADDED).withColumns({"size": word_count(whole), "mix_order": order})


def source_targets(
    parts: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """One row per source: ``source_size`` and ``target``.

    Shares that would exceed ``max_repeats`` times a source are cut there and the excess is shared
    again by weight. Sorted by size per weight, the cut sources are a prefix: the level is the
    first one that does not cut the source it was computed from. One row per source is held.
    """
    # "-" (null) sorts behind "+name" by its own flag.
    ordered = Window.orderBy(F.col("mix_source") == "-", "mix_source")
    sources = (
        parts.groupBy("mix_source")
        .agg(F.sum("part_size").alias("source_size"))
        .withColumn("position", F.row_number().over(ordered))
        .withColumn(
            "weight",
            F.element_at(
                F.array(*map(F.lit, weights)),
                ((F.col("position") - 1) % len(weights) + 1).cast("int"),
            ),
        )
        .withColumn("most", F.col("source_size") * max_repeats)
        .withColumn("fill", F.col("most") / F.col("weight"))
    )
    rising = Window.orderBy("fill", "position")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("fill", "position").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    ) / F.sum("weight").over(onward)
    return (
        sources.withColumn("level", level)
        .withColumn(
            "common_level",
            F.first(
                F.when(F.col("level") <= F.col("fill"), F.col("level")), ignorenulls=True
            ).over(everything),
        )
        .select(
            "mix_source",
            "source_size",
            F.least(F.col("common_level") * F.col("weight"), F.col("most").cast("double")).alias(
                "target"
            ),
        )
    )


def mix(
    measured: DataFrame, source: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` (words, repeats counted) to measured rows.

    ``measured`` is read several times, so hand over a table and not a long computation. Running
    sums are kept per part of a source, so a source with a third of all rows is many groups.
    """
    name = F.col(source).cast("string")
    parted = measured.withColumns(
        {
            "mix_source": F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name)),
            "mix_part": F.substring("mix_order", 1, PART_DIGITS),
        }
    )
    parts = cut_lineage(
        parted.groupBy("mix_source", "mix_part").agg(F.sum("size").alias("part_size"))
    )
    targets = source_targets(parts, weights, max_repeats)
    earlier = (
        Window.partitionBy("mix_source")
        .orderBy("mix_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = parts.join(targets, "mix_source").select(
        "mix_source",
        "mix_part",
        "source_size",
        "target",
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"),
    )
    running = (
        Window.partitionBy("mix_source", "mix_part")
        .orderBy("mix_order")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    queued = (
        parted.withColumn("mix_end", F.sum("size").over(running))
        .join(starts, ["mix_source", "mix_part"])
        .withColumn("mix_end", F.col("mix_end") + F.col("part_start"))
        .drop("part_start", "mix_part", "mix_source")
    )
    finish, order = _last_turn(queued, parts, max_repeats)
    taken_turns = sum(
        F.when(
            (F.col("size") > 0)
            & ((turn < finish) | ((turn == finish) & (F.col("mix_order") <= order))),
            1,
        ).otherwise(0)
        for turn in map(_turn, range(max_repeats))
    )
    return queued.withColumn("taken", F.col("size") * taken_turns).drop("mix_end", "mix_order")


def _turn(repeat: int):
    """The virtual finish time of a document's turn; only asked for documents with words."""
    return F.when(
        F.col("size") > 0,
        (F.col("mix_end") + F.lit(repeat) * F.col("source_size")) / F.col("target"),
    )


def _last_turn(queued: DataFrame, parts: DataFrame, max_repeats: int) -> tuple:
    """Finish time and order of the last turn that the budget still holds.

    Turns are put in ranges of finish time, and these in parts. Running totals over ranges, then
    over the parts of the range that crosses the budget, leave one part to be sorted.
    """
    scaled = F.col("finish") * RANGES
    turns = cut_lineage(
        queued.filter(F.col("size") > 0)
        .select(
            "size",
            "mix_order",
            F.explode(F.array(*map(_turn, range(max_repeats)))).alias("finish"),
        )
        .withColumn("range", F.least(F.floor(scaled), F.lit(2 * RANGES)).cast("int"))
        .withColumn(
            "part", F.least(F.floor((scaled - F.col("range")) * RANGES), F.lit(RANGES)).cast("int")
        )
    )
    left = parts.agg(F.sum("part_size")).first()[0] or 0
    for level in ("range", "part"):
        crossing = _crossing(turns, level, left)
        if crossing is None:
            return F.lit(-1.0), F.lit("")
        left -= crossing["through"] - crossing["total"]
        turns = turns.filter(F.col(level) == crossing[level])
    inside = Window.orderBy("finish", "mix_order").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = turns.withColumn("through", F.sum("size").over(inside)).agg(
        F.max(F.when(F.col("through") <= left, F.struct("finish", "mix_order"))).alias("last"),
        F.min("finish").alias("first"),
    ).first()
    if ends["last"] is None:
        return F.lit(ends["first"]), F.lit("")
    return F.lit(ends["last"]["finish"]), F.lit(ends["last"]["mix_order"])


def _crossing(turns: DataFrame, level: str, budget: int):
    """The first range whose running total reaches the budget; a bounded number of ranges."""
    so_far = Window.orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        turns.groupBy(level)
        .agg(F.sum("size").alias("total"))
        .withColumn("through", F.sum("total").over(so_far))
        .filter(F.col("through") >= budget)
        .orderBy(level)
        .first()
    )


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the input's columns."""
    inputs, restored = set_aside(docs, ADDED)
    result = mix(measure(inputs, doc_id, text), source, weights, max_repeats)
    turns = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    kept = result.filter((F.col("size") > 0) & (F.col("taken") > 0))
    return kept.withColumn("mix_turn", F.explode(turns)).select(*restored)
