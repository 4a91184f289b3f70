"""Rule-based intent classification as generated columns.

Every rule compiles to built-in expressions over one lower-cased column, so classification is a
single pass without joins or shuffles.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.functions.arrays import explode_computed, settle
from threadwise.functions.regex import search, word_pattern, words_found
from threadwise.functions.text import long_words
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK, RulePack

LOWERED = "_lowered"


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """An ordered decision table: the value beside the first condition that holds."""
    (condition, value), *rest = cases
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def with_lowered(messages: DataFrame, text: str) -> DataFrame:
    """Add the lower-cased text once for all rules that follow."""
    return messages.withColumn(LOWERED, F.lower(F.coalesce(F.col(text), F.lit(""))))


def taxonomy(spark: SparkSession, pack: RulePack = SUPPORT_PACK) -> DataFrame:
    """The intents as a small table, in order."""
    schema = T.StructType(
        [
            T.StructField("ord", T.IntegerType()),
            T.StructField("intent", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("keywords", T.ArrayType(T.StringType())),
            T.StructField("default_action", T.StringType()),
            T.StructField("label", T.StringType()),
        ]
    )
    rows = [
        (i, x.name, x.description, list(x.keywords), x.default_action, x.label)
        for i, x in enumerate(pack.intents)
    ]
    return spark.createDataFrame(rows, schema)


def _keyword_entries(pack: RulePack) -> Column:
    """Every keyword as one constant array, which keeps plans and generated code small."""
    entries = [
        {"ord": i, "literal": keyword, "pattern": word_pattern(keyword)}
        for i, intent in enumerate(pack.intents)
        for keyword in intent.keywords
    ]
    return F.from_json(
        F.lit(json.dumps(entries)), "array<struct<ord: int, literal: string, pattern: string>>"
    )


def with_hits(messages: DataFrame, text: str = "message", pack: RulePack = SUPPORT_PACK) -> DataFrame:
    """Add ``hits``: array of (ord, intent, hits) in taxonomy order.

    A keyword counts once however often it occurs; overlapping keywords all count.
    """
    found = words_found(F.col(LOWERED), _keyword_entries(pack))

    # One reference per intent: Spark keeps a column it sees several times as it is, but would
    # move a single use inside a lambda and evaluate it once per element.
    def entry(i: int, name: str) -> Column:
        count = F.size(F.filter("_found", lambda e: e["ord"] == i))
        return F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("intent"), count.alias("hits")
        )

    hits = [entry(i, intent.name) for i, intent in enumerate(pack.intents)]
    return (
        with_lowered(messages, text)
        .withColumn("_found", found)
        .withColumn("hits", F.array(*hits))
        .drop("_found", LOWERED)
    )


def hit_table(
    messages: DataFrame, key: str = "msg_id", text: str = "message", pack: RulePack = SUPPORT_PACK
) -> DataFrame:
    """(key, intent, hits): one row per message and intent."""
    return (
        with_hits(messages.select(key, text), text, pack)
        .select(key, F.explode("hits").alias("entry"))
        .select(key, "entry.intent", "entry.hits")
    )


def _ranked(hits: Column) -> Column:
    """Intents with at least one hit, most hits first, ties in taxonomy order."""
    sortable = F.transform(
        F.filter(hits, lambda x: x["hits"] > 0),
        lambda x: F.struct(
            (-x["hits"]).alias("minus"), x["ord"].alias("ord"),
            x["intent"].alias("intent"), x["hits"].alias("hits"),
        ),
    )
    return F.array_sort(sortable)


def classify_by_keywords(
    messages: DataFrame, text: str = "message", pack: RulePack = SUPPORT_PACK
) -> DataFrame:
    """Add intent, intents, confidence, reasoning and best_hits from keyword hits alone."""
    ranked = with_hits(messages, text, pack).withColumn("ranked", _ranked(F.col("hits")))
    best = F.coalesce(F.get(F.col("ranked"), F.lit(0))["hits"], F.lit(0))
    any_hit = F.col("best_hits") > 0
    near_best = F.filter(
        F.col("ranked"), lambda x: x["hits"] >= F.greatest(F.lit(1), F.col("best_hits") - 1)
    )
    confidence = F.round(
        F.least(
            fixed.CONFIDENCE_BASE + F.col("best_hits") * fixed.CONFIDENCE_PER_HIT,
            F.lit(fixed.CONFIDENCE_CEILING),
        ),
        2,
    )
    classified = (
        ranked.withColumn("best_hits", best)
        .withColumn(
            "intent",
            F.coalesce(F.get(F.col("ranked"), F.lit(0))["intent"], F.lit(pack.fallback_intent)),
        )
        .withColumn(
            "intents",
            F.when(
                any_hit,
                F.slice(F.transform(near_best, lambda x: x["intent"]), 1, fixed.MAX_INTENTS),
            ).otherwise(F.array(F.lit(pack.fallback_intent))),
        )
        .withColumn(
            "confidence", F.when(any_hit, confidence).otherwise(F.lit(fixed.CONFIDENCE_NO_HIT))
        )
        .withColumn(
            "reasoning",
            F.when(any_hit, F.format_string(wording.HIT_REASONING, "best_hits")).otherwise(
                F.lit(wording.NO_HIT_REASONING)
            ),
        )
        .drop("hits", "ranked")
    )
    return settle(classified, "intent", "intents", "confidence", "reasoning", "best_hits")


def override_name(lowered: Column, pack: RulePack = SUPPORT_PACK) -> Column:
    """Name of the first override whose patterns all occur, else null."""
    cases = [
        (all_of([search(lowered, p) for p in rule.patterns]), F.lit(rule.name))
        for rule in pack.overrides
    ]
    return first_match(cases, F.lit(None).cast("string")) if cases else F.lit(None).cast("string")


def _settled(lowered: Column, intent: Column, pack: RulePack) -> Column:
    return any_of(
        [
            intent.isin(*entry.intents)
            & (any_of([search(lowered, p) for p in entry.patterns]) if entry.patterns else F.lit(True))
            for entry in pack.settled
        ]
    )


def classify(
    messages: DataFrame, text: str = "message", pack: RulePack = SUPPORT_PACK
) -> DataFrame:
    """Add intent, intents, confidence, reasoning, override and needs_model.

    ``needs_model`` is false where the rules settle the message and no model would be asked.
    """
    by_keywords = with_lowered(classify_by_keywords(messages, text, pack), text).withColumn(
        "override", override_name(F.col(LOWERED), pack)
    )
    override = F.col("override")

    def pick(column: str, value) -> Column:
        cases = [(override == rule.name, value(rule)) for rule in pack.overrides]
        return first_match(cases, F.col(column)) if cases else F.col(column)

    classified = (
        by_keywords.withColumn("intent", pick("intent", lambda r: F.lit(r.intent)))
        .withColumn("intents", pick("intents", lambda r: F.array(F.lit(r.intent))))
        .withColumn("confidence", pick("confidence", lambda r: F.lit(fixed.CONFIDENCE_CEILING)))
        .withColumn("reasoning", pick("reasoning", lambda r: F.lit(r.reasoning)))
        .withColumn("needs_model", ~_settled(F.col(LOWERED), F.col("intent"), pack))
        .drop(LOWERED, "best_hits")
    )
    return settle(
        classified, "intent", "intents", "confidence", "reasoning", "override", "needs_model"
    )


def weak_label(
    messages: DataFrame, text: str = "message", label: str = "weak_label",
    pack: RulePack = SUPPORT_PACK,
) -> DataFrame:
    """Add the intent with the most keyword hits; overrides do not apply."""
    hits = with_hits(messages, text, pack)
    best = F.get(_ranked(F.col("hits")), F.lit(0))["intent"]
    labelled = hits.withColumn(label, F.coalesce(best, F.lit(pack.fallback_intent)))
    return settle(labelled.drop("hits"), label)


def display_label(
    classified: DataFrame, text: str = "message", pack: RulePack = SUPPORT_PACK
) -> DataFrame:
    """Add ``display_label``; an unknown intent shows its raw name."""
    intent = F.col("intent")
    duplicate = (intent == fixed.BILLING_INTENT) & search(
        F.lower(text), fixed.DUPLICATE_CHARGE_LABEL_PATTERN
    )
    cases = [(duplicate, F.lit(fixed.DUPLICATE_CHARGE_LABEL))] + [
        (intent == entry.name, F.lit(entry.label)) for entry in pack.intents if entry.label
    ]
    return classified.withColumn("display_label", first_match(cases, intent))


def top_words(queries: DataFrame, text: str = "initial_query", n: int = 20) -> DataFrame:
    """The ``n`` most frequent words of more than three characters, ties alphabetical."""
    words = explode_computed(queries, long_words(F.col(text)), "word")
    counted = words.groupBy("word").agg(F.count("*").alias("occurrences"))
    return counted.orderBy(F.desc("occurrences"), "word").limit(n)


def query_count(queries: DataFrame, text: str = "initial_query") -> DataFrame:
    return queries.agg(F.count(text).alias("queries"))
