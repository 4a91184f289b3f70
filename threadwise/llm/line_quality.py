"""Quality rules: measures of a text, and how often its lines occur across a host's documents.

Lines are normalised and hashed. A line's frequency is the number of distinct texts of its host that
hold it, so exact copies count once. Lines above the limit, which grows with the square root of the
host's texts, are removed, and a document is rejected if too little of it remains: too few words
after losing half of them, or too small a share of its words whatever their number.

Defined results: null text has no words and fails the base rules; a null host is a host of its own;
a text without lines has nothing to remove; equal rows get equal results; an empty table gives an
empty table. Input columns named like a column the operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import (
    SPACE,
    SPACE_CHARS,
    WORD,
    drop_columns,
    let,
    set_aside,
    whole_text,
)
from threadwise.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3
# A line is removed when more texts of a host hold it than this and than the root of their number.
MIN_DOCUMENTS = 20
# A document is depleted when fewer words remain than this and less than this share of its words,
# or less than the smaller share, however many words that is.
MIN_LEFT = 50
MIN_LEFT_SHARE = 0.5
LEAST_SHARE = 0.2
# A line in most documents of a host is one key with most rows: its rows are dealt to this many.
SALTS = 32
# Up to so many frequent lines are sent to the texts; of a host, in as many lists by their hash.
LOOKED_UP = 200_000
LISTS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
)
ADDED = (
    *MEASURES, "kept", "removed_words", "clean_text",
    "quality_host", "quality_text", "quality_lines", "removed_lines",
)


# --- one text ----------------------------------------------------------------------------------


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: _without(line, SPACE_CHARS) != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text holds at least twice."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, _covered_by_repeats)

    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + place) for place in range(WINDOW)]),
    )
    counted = let(
        windows,
        lambda hashes: F.when(
            F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)
        ).otherwise(covered(hashes)),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(counted)


def _covered_by_repeats(placed: Column) -> Column:
    """Words under the windows that have an equal neighbour in hash order."""
    last = F.size(placed) - 1
    repeats = F.filter(
        placed,
        lambda window, i: ((i > 0) & (F.get(placed, i - 1)["h"] == window["h"]))
        | ((i < last) & (F.get(placed, i + 1)["h"] == window["h"])),
    )
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(F.transform(repeats, lambda window: window["i"])),
        start,
        lambda seen, i: F.struct(
            (seen["words"] + i + WINDOW - F.greatest(i, seen["end"])).alias("words"),
            (i + WINDOW).alias("end"),
        ),
        lambda seen: seen["words"],
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each text and whether they fail the base rules."""
    whole = whole_text(text)

    def measure(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(_without(whole, SPACE_CHARS)).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    measured = let(
        F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
        lambda words: let(lines_with_words(whole), lambda lines: measure(words, lines)),
    )
    # A generator is evaluated once, whatever later reads of its columns there are.
    return (
        drop_columns(docs, *MEASURES)
        .select("*", F.inline(F.array(measured)))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
    )


# --- lines across documents --------------------------------------------------------------------


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, with digits and white space as one space."""
    lowered = F.translate(line, UPPER, LOWER)
    return F.md5(F.trim(F.regexp_replace(lowered, SPACE[:-1] + "0-9]+", " ")))


def _keyed(docs: DataFrame, text: str, host: str) -> DataFrame:
    name = F.col(host).cast("string")
    return docs.withColumns(
        {
            "quality_host": F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name)),
            "quality_text": F.md5(whole_text(text)),
        }
    )


def frequent_lines(texts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(host, line key) of the lines above the limits.

    ``texts`` holds each text of a host once; its lines are counted in every task before they are
    shuffled, so a line that a third of all texts hold arrives as one row per task.
    """
    size = texts.groupBy("quality_host").agg(F.count("*").alias("documents"))
    held = (
        texts.select("quality_host", F.explode(F.array_distinct("quality_lines.line")).alias("line"))
        .groupBy("quality_host", "line")
        .agg(F.count("*").alias("frequency"))
        .filter(F.col("frequency") > min_documents)
    )
    return (
        held.join(size, "quality_host")
        .filter(F.col("frequency") > F.sqrt("documents"))
        .select("quality_host", "line")
    )


def removed_lines(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, text key, ``removed_words``, ``removed_lines``) of texts that hold frequent lines."""
    salt = F.pmod(F.xxhash64("quality_text"), F.lit(SALTS))
    lines = texts.select(
        "quality_host", "quality_text", salt.alias("salt"), F.inline("quality_lines")
    )
    dealt = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        lines.join(
            dealt.withColumn("salt", F.col("salt").cast("long")), ["quality_host", "line", "salt"]
        )
        .groupBy("quality_host", "quality_text")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    )


def _keyed_lines(text: str) -> Column:
    return F.transform(
        lines_with_words(whole_text(text)),
        lambda line: F.struct(
            line_key(line).alias("line"),
            F.regexp_count(line, F.lit(WORD)).cast("long").alias("words"),
        ),
    )


def _list_of(line: Column) -> Column:
    return F.pmod(F.xxhash64(line), F.lit(LISTS)).cast("int")


def look_up(docs: DataFrame, text: str, frequent: DataFrame) -> DataFrame:
    """Add ``removed_words`` and ``removed_lines`` where the texts lie; ``frequent`` is broadcast."""
    lists = (
        frequent.groupBy("quality_host", _list_of(F.col("line")).alias("list"))
        .agg(F.collect_list("line").alias("lines"))
        .groupBy("quality_host")
        .agg(F.map_from_entries(F.collect_list(F.struct("list", "lines"))).alias("quality_lines"))
    )

    def summed(removed: Column) -> Column:
        words = F.aggregate(removed, F.lit(0).cast("long"), lambda n, line: n + line["words"])
        return F.struct(words.alias("removed_words"), removed["line"].alias("removed_lines"))

    found = F.filter(
        _keyed_lines(text),
        lambda line: F.array_contains(
            F.try_element_at("quality_lines", _list_of(line["line"])), line["line"]
        ),
    )
    joined = docs.join(F.broadcast(lists), "quality_host", "left")
    # A generator is evaluated once, as in with_measures.
    return joined.select("*", F.inline(F.array(let(found, summed)))).drop("quality_lines")


def with_verdict(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    texts_stay: bool = False,
) -> DataFrame:
    """Add the measures, ``removed_words``, ``clean_text`` (frequent lines removed) and ``kept``.

    A text's lines are collected once per host and text, so copies are neither counted nor joined
    more than once, and the texts themselves are never shuffled to count lines. Where the result
    holds the texts, ``texts_stay`` saves their shuffle as well: their lines are hashed a second
    time and looked up among the frequent ones, unless these are too many to be broadcast.
    """
    keyed = _keyed(drop_columns(docs, *ADDED), text, host)
    texts = cut_lineage(
        keyed.select("quality_host", "quality_text", _keyed_lines(text).alias("quality_lines"))
        .groupBy("quality_host", "quality_text")
        .agg(F.any_value("quality_lines").alias("quality_lines"))
        .filter(F.size("quality_lines") > 0)
    )
    frequent = frequent_lines(texts, min_documents)
    if texts_stay:
        frequent = cut_lineage(frequent)
        texts_stay = frequent.limit(LOOKED_UP + 1).count() <= LOOKED_UP
    judged = with_measures(keyed, text)
    if texts_stay:
        judged = look_up(judged, text, frequent)
    else:
        # Written, so that a text with a third of all rows as copies can be split in the join.
        removed = cut_lineage(removed_lines(texts, frequent))
        judged = judged.join(removed, ["quality_host", "quality_text"], "left").withColumn(
            "removed_words", F.coalesce("removed_words", F.lit(0))
        )
    left = F.col("n_words") - F.col("removed_words")
    few = (left < MIN_LEFT) & (left < MIN_LEFT_SHARE * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & (few | (left < LEAST_SHARE * F.col("n_words")))
    clean = F.array_join(
        F.filter(
            F.split(F.col(text), "\n", -1),
            # A line of digits has the key of an empty one, which stays.
            lambda line: (_without(line, SPACE_CHARS) == "")
            | ~F.array_contains("removed_lines", line_key(line)),
        ),
        "\n",
    )
    return judged.withColumns(
        {
            "kept": ~F.col("base_failed") & ~depleted,
            "clean_text": F.when(F.col("removed_words") > 0, clean).otherwise(F.col(text)),
        }
    ).drop("quality_host", "quality_text", "removed_lines")


def accepted(
    docs: DataFrame, text: str = "text", host: str = "source", length: str = "n_chars"
) -> DataFrame:
    """The documents the rules keep, without their frequent lines, with their length adjusted.

    Columns are the input's.
    """
    inputs, restored = set_aside(docs, ADDED)
    result = with_verdict(inputs, text, host, texts_stay=True).filter("kept")
    if length in docs.columns:
        cleaned = F.length("clean_text").cast(docs.schema[length].dataType)
        result = result.withColumn(
            length, F.when(F.col("removed_words") > 0, cleaned).otherwise(F.col(length))
        )
    return result.withColumn(text, F.col("clean_text")).select(*restored)
