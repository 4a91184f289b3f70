"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Two lexicons feed the features: a short fixed one, and words and word beginnings whose document
frequency in toxic training texts is far above that in others. Features are the density and weight
of lexicon words, how near they stand to words for the reader (second person), capitals,
punctuation, repetition, and how often words are disguised with digits or signs, as well as
whether such a word is in the lexicon once the disguise is undone.

Labels are learned only from rows of the training part: a bounded sample (``TRAINING_ROWS``) in the
order of a hash of the id. One half teaches the lexicon; the other, which the lexicon has not seen,
teaches the trees (two thirds) and their calibration (one third). Scores of equal texts are equal:
neither ids, languages, sources nor labels enter them.

Defined results: null text is the empty text; rows whose label is null are not learned from, an id
labelled twice counts as often as it is labelled; without both labels in the training part every
score is the share of toxic training rows (0 without any); a null id is in the held-out part; an
empty table gives an empty table. Input columns named like a column the operator adds are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.llm.common import drop_columns, let, set_aside, whole_text
from threadwise.session import cut_lineage

# The part of the ids that is never learned from.
FOLDS = 5
# Most rows that are learned from, words of the learned lexicon, and how sure a word must be.
TRAINING_ROWS = 40_000
LEXICON_WORDS = 20_000
MIN_TEXTS = 4
MIN_LOG_ODDS = 2.0
BEGINNINGS = (4, 5, 6, 7)
# Words on either side in which a word for the reader counts as near.
NEAR = 4
TREES, DEPTH, STEP = 30, 4, 0.2
MAX_PARTITIONS = 8

# Plain insults and words for the reader, by language (en, de, fr, es).
INSULTS = frozenset(
    """
    idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk creep
    idiotisch dumm dummkopf trottel abschaum versager widerlich erbärmlich
    idiote stupide crétin imbécile ordure minable dégoûtant abruti
    idiota estúpido imbécil basura patético asqueroso inútil tonto
    """.split()
)
READER = frozenset(
    """
    you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre
    vos usted ustedes tú ti tus vosotros
    """.split()
)
PLAIN = str.maketrans("01345789@$!|", "oieastbgasil", "*")

WORD = re.compile(r"[^\W\d_]+")
# Starts at the head of a word and never gives back, so very long words are passed over once.
DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0134578@$!|*]++[^\W\d_]++)++")
DOTTED = re.compile(r"(?<!\w)[^\W\d_](?:[.\-_*·][^\W\d_]){2,}(?!\w)")
# A sign before a letter, and a letter between signs: without these there is no disguise.
SIGN_THEN_LETTER = re.compile(r"[0134578@$!|*][^\W\d_]")
LETTER_AMONG_SIGNS = re.compile(r"[.\-_*·][^\W\d_][.\-_*·]")
FEATURES = (
    "log_words", "insults", "learned", "beginnings", "weight", "top_weight", "near_reader",
    "near_hits", "readers", "disguised", "disguised_hits", "repeated",
    "capitals", "exclamations", "signs", "digits",
)
# Bytes whose share of a text is a feature.
SHARES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"#*$%&|<>@^~", b"0123456789")
SPACE_BYTES = b" \t\n\x0b\f\r"
# Words that one task remembers.
REMEMBERED = 300_000
ADDED = ("toxicity", "score", "predicted", "held_out")
# Columns that the fitted stages write on the way.
WRITTEN = ("toxic_features", "toxic_raw", "toxic_calibrated", "probability", "prediction", "rawprediction")


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    beginnings: dict[str, float]


# --- one text ----------------------------------------------------------------------------------


class Kinds(dict):
    """(fixed insult, learned word, weight) of a word, or None; a word is classed when first met."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        weight = self.lexicon.words.get(word, 0.0)
        beginnings = self.lexicon.beginnings
        start = max(beginnings.get(word[:size], 0.0) if size < len(word) else 0.0 for size in BEGINNINGS)
        found = (word in INSULTS, weight > 0, max(weight, start))
        self[word] = kind = found if found[0] or found[2] else None
        return kind


def features(text: str, lexicon: Lexicon, kinds: Kinds | None = None) -> tuple[float, ...]:
    """The values of ``FEATURES`` for one text."""
    kinds = Kinds(lexicon) if kinds is None else kinds
    words = WORD.findall(text.lower())
    different = set(words)
    n = max(len(words), 1)
    hot = {word: kind for word in different if (kind := kinds[word])}
    hits = [place for place, word in enumerate(words) if word in hot] if hot else []
    found = [hot[words[place]] for place in hits]
    used = different & READER
    readers = [place for place, word in enumerate(words) if word in READER] if used and hits else []
    n_readers = len(readers) if hits else sum(map(words.count, used))
    disguised, dotted = [], []
    if SIGN_THEN_LETTER.search(text):
        disguised = [m.group().lower().translate(PLAIN) for m in DISGUISED.finditer(text)]
    if LETTER_AMONG_SIGNS.search(text):
        dotted = [re.sub(r"[.\-_*·]", "", m.group().lower()) for m in DOTTED.finditer(text)]
    undone = [w for w in disguised + dotted if w in INSULTS or w in lexicon.words]
    raw = text.encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)
    return (
        math.log1p(len(words)),
        sum(insult for insult, _, _ in found) / n,
        sum(known for _, known, _ in found) / n,
        sum(not insult and not known for insult, known, _ in found) / n,
        sum(weight for _, _, weight in found) / n,
        max((weight for _, _, weight in found), default=0.0),
        _near(hits, readers) / n,
        float(len(hits)),
        n_readers / n,
        (len(disguised) + len(dotted)) / n,
        float(len(undone)),
        1 - len(different) / n if words else 0.0,
        *(1 - len(raw.translate(None, group)) / len(raw) if raw else 0.0 for group in SHARES),
    )


def _near(hits: list[int], readers: list[int]) -> int:
    """Hits with a word for the reader within ``NEAR`` words; both lists rise."""
    if not hits or not readers:
        return 0
    after = np.searchsorted(readers, hits)
    placed = np.array([-(10**9), *readers, 10**9])
    places = np.array(hits)
    return int((np.minimum(places - placed[after], placed[after + 1] - places) <= NEAR).sum())


# --- Spark -------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def training_sample(labels: DataFrame, doc_id: str, label: str, rows: int) -> DataFrame:
    """(``id``, ``label``, ``lot``) of at most about ``rows`` labelled rows, by a hash of the id."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).filter(
        ~held_out(F.col(doc_id))
    )
    lots = usable.select(
        F.col(doc_id).alias("id"),
        (F.col(label) == 1).cast("double").alias("label"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1_000_000)).alias("lot"),
    )
    most = min(1.0, rows / max(lots.count(), 1)) * 1_000_000
    return lots.filter(F.col("lot") < int(most))


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """From (``label``, ``text``) rows: words and beginnings that tell toxic texts from others."""
    totals = {
        row["label"]: row["n"] for row in texts.groupBy("label").agg(F.count("*").alias("n")).collect()
    }
    toxic, other = totals.get(1.0, 0), totals.get(0.0, 0)
    if not toxic or not other:
        return Lexicon({}, {})
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))

    def units(found: Column) -> Column:
        """Words, and beginnings with a mark in front, each once."""
        starts = [
            F.transform(
                F.filter(found, lambda word, size=size: F.length(word) > size),
                lambda word, size=size: F.concat(F.lit("^"), F.substring(word, 1, size)),
            )
            for size in BEGINNINGS
        ]
        return F.array_distinct(F.concat(found, *starts))

    odds = F.log(((F.col("p") + 0.5) / (toxic + 1)) / ((F.col("q") + 0.5) / (other + 1)))
    best = (
        texts.select("label", F.explode(let(words, units)).alias("unit"))
        .groupBy("unit")
        .agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
        .filter(F.col("p") >= MIN_TEXTS)
        .withColumn("odds", odds)
        .filter(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy(F.desc(F.col("odds") * F.sqrt("p")), "unit")
        .limit(LEXICON_WORDS)
        .select("unit", "odds")
        .collect()
    )
    return Lexicon(
        {row["unit"]: row["odds"] for row in best if row["unit"][0] != "^"},
        {row["unit"][1:]: row["odds"] for row in best if row["unit"][0] == "^"},
    )


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add a struct ``toxicity`` with ``FEATURES``, all doubles."""

    @F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES]))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kinds = Kinds(lexicon)
        for texts in batches:
            yield pd.DataFrame(
                [features(t, lexicon, kinds) for t in texts], columns=list(FEATURES), dtype=float
            )

    return drop_columns(docs, *ADDED).withColumn("toxicity", count(whole_text(text)))


@dataclass
class Scorer:
    """A fitted model: trees and calibration, or a constant where there was nothing to learn."""

    trees: object = None
    calibration: object = None
    constant: float = 0.0

    def score(self, featured: DataFrame) -> DataFrame:
        """Add ``score`` to rows with ``toxicity``."""
        if self.trees is None:
            return featured.withColumn("score", F.lit(float(self.constant)))
        raw = _raw_scores(self.trees, featured)
        calibrated = self.calibration.transform(raw)
        # Calibration makes steps; the trees order what shares a step.
        score = F.col("toxic_calibrated") * 0.99 + F.col("toxic_raw") * 0.01
        return calibrated.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).drop(
            "toxic_calibrated", "toxic_raw"
        )


def _raw_scores(trees, featured: DataFrame) -> DataFrame:
    flat = featured.select("*", *[F.col("toxicity")[n].alias(f"toxic_{n}") for n in FEATURES])
    found = trees.transform(flat)
    return found.select(
        *featured.columns, vector_to_array("probability")[1].alias("toxic_raw")
    )


def fit(rows: DataFrame, seed: int = 42) -> Scorer:
    """Fit on (``label``, ``lot``, ``toxicity``) rows, a bounded sample."""
    rows = cut_lineage(rows.coalesce(MAX_PARTITIONS))
    counts = {
        (row["part"], row["label"]): row["n"]
        for row in rows.groupBy((F.col("lot") % 3 == 0).alias("part"), "label")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    total = sum(counts.values())
    if len(counts) < 4:
        toxic = sum(n for (_, label), n in counts.items() if label == 1)
        return Scorer(constant=toxic / total if total else 0.0)
    names = [f"toxic_{name}" for name in FEATURES]
    flat = rows.select("label", "lot", "toxicity", *[
        F.col("toxicity")[name].alias(f"toxic_{name}") for name in FEATURES
    ])
    trees = Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="toxic_features"),
            GBTClassifier(
                labelCol="label", featuresCol="toxic_features", maxIter=TREES, maxDepth=DEPTH,
                stepSize=STEP, seed=seed,
            ),
        ]
    ).fit(flat.filter("lot % 3 <> 0"))
    unseen = _raw_scores(trees, rows.filter("lot % 3 = 0"))
    calibration = IsotonicRegression(
        labelCol="label", featuresCol="toxic_raw", predictionCol="toxic_calibrated"
    ).fit(unseen)
    return Scorer(trees, calibration)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = TRAINING_ROWS,
) -> DataFrame:
    """Documents without their text, with ``held_out``, ``score`` and ``predicted``.

    The sample's ids are few enough to broadcast, so finding its texts shuffles nothing.
    """
    docs, restored = set_aside(drop_columns(docs, *ADDED), WRITTEN)
    kept = [column for column, name in zip(restored, docs.columns) if name != text]
    sample = cut_lineage(training_sample(labels, doc_id, label, rows))
    texts = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text"))
    lexicon_texts = texts.join(F.broadcast(sample.filter("lot % 2 = 0")), "id").select("label", "text")
    lexicon = learn_lexicon(cut_lineage(lexicon_texts))
    featured = cut_lineage(with_features(docs, lexicon, text).drop(text))
    taught = featured.select(F.col(doc_id).alias("id"), "toxicity").join(
        F.broadcast(sample.filter("lot % 2 = 1")), "id"
    )
    scorer = fit(taught.select("label", "lot", "toxicity"))
    return scorer.score(featured).select(
        *kept,
        held_out(F.col(doc_id)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
