"""Baseline intent classifiers: the majority label, and TF-IDF with logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.operators.tfidf import (
    bounded_broadcast,
    term_counts,
    together,
    vocabulary,
    weights,
)
from threadwise.rules import fixed_values as fixed
from threadwise.rules.stop_words import ENGLISH
from threadwise.session import cut_lineage, settle


# A taxonomy is a list people keep in mind; more labels are a mistake in the caller's table.
MAX_LABELS = 1000
# Relative change of the loss at which fitting ends.
TOLERANCE = 1e-12
# Bytes of text whose vectors one task of the fit holds. In every step each task sends the gradient of
# all coefficients, so there are as many as the rows need and no more.
FIT_TEXT_PER_TASK = 16_000_000


def majority_label(
    training: DataFrame, label: str = "label", default: str = fixed.FALLBACK_INTENT
) -> DataFrame:
    """One row, ``majority``: the most frequent label, ties alphabetical."""
    counts = training.groupBy(label).agg(F.count("*").alias("n"))
    best = F.min_by(label, F.struct(-F.col("n"), F.col(label)))
    return counts.agg(F.coalesce(best, F.lit(default)).alias("majority"))


def predict_majority(
    messages: DataFrame, training: DataFrame, label: str = "label"
) -> DataFrame:
    """Messages with ``predicted`` set to the training majority."""
    return messages.withColumn("predicted", majority_label(training, label).scalar())


@dataclass
class TextClassifier:
    """A fitted linear model as tables: (term_id, coefficients) over the vocabulary."""

    vocab: DataFrame
    coefficients: DataFrame
    intercepts: list[float]
    labels: list[str]
    max_features: int
    stop_words: list[str]
    penalty: float = 0.0

    def vectors(self, messages: DataFrame, key: str, text: str) -> DataFrame:
        """(key, term_id, w): the weights of the messages' known terms."""
        rows = messages.select(
            key, F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(1).alias("copies")
        )
        counts = term_counts(rows, key, self.stop_words, self.vocab, self.max_features)
        return weights(counts, key, self.vocab, self.max_features)

    def scores(self, messages: DataFrame, key: str = "msg_id", text: str = "message") -> DataFrame:
        """(key, scores): a score per label for every message, also one without known terms."""
        sums = [
            F.sum(F.col("w") * F.col("coefficients")[i]).alias(f"s{i}")
            for i in range(len(self.labels))
        ]
        summed = (
            self.vectors(messages, key, text)
            .join(bounded_broadcast(self.coefficients, self.max_features), "term_id")
            .groupBy(key)
            .agg(*sums)
        )
        scores = F.array(
            *[
                F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + self.intercepts[i]
                for i in range(len(self.labels))
            ]
        )
        return messages.select(key).join(summed, key, "left").select(key, scores.alias("scores"))

    def predict(self, messages: DataFrame, key: str = "msg_id", text: str = "message") -> DataFrame:
        """(key, predicted): the label with the highest score, ties alphabetical."""
        best = F.array_position("scores", F.array_max("scores")).cast("int")
        names = F.array(*[F.lit(name) for name in self.labels])
        return self.scores(messages, key, text).select(
            key, F.element_at(names, best).alias("predicted")
        )

    def gradient(
        self, training: DataFrame, key: str = "msg_id", text: str = "message", label: str = "label"
    ) -> DataFrame:
        """(label, term_id, held, gradient): how far each coefficient is from the optimum.

        ``held`` is the weight of a term in the training rows of a label, ``gradient`` the
        derivative of the penalised loss by the coefficient. The loss is convex, so the model is
        the one that a training table asks for exactly where all gradients vanish; that can be
        checked without fitting again. Intercepts have the null ``term_id``; labels and terms of
        the model are all there, also those that never meet.
        """
        rows = training.select(key, text, label)
        highest = F.array_max("scores")
        exps = F.transform("scores", lambda s: F.exp(s - highest))
        total = F.aggregate(exps, F.lit(0.0), lambda x, y: x + y)
        names = F.array(*[F.lit(name) for name in self.labels])
        shares = (
            self.scores(rows, key, text)
            .select(key, F.transform(exps, lambda e: e / total).alias("shares"))
            .join(rows.select(key, F.col(label).alias("truth")), key)
        )
        shares = cut_lineage(shares)
        weighed = self.vectors(rows, key, text).unionByName(
            rows.select(key, F.lit(None).cast("int").alias("term_id"), F.lit(1.0).alias("w"))
        )
        # A term and a label meet in one row per task: sums are combined before the shuffle.
        sums = [
            F.struct(
                F.sum(F.when(F.col("truth") == name, F.col("w")).otherwise(0.0)).alias("held"),
                F.sum(F.col("w") * F.col("shares")[i]).alias("expected"),
            )
            for i, name in enumerate(self.labels)
        ]
        per_term = (
            weighed.join(shares, key)
            .groupBy("term_id")
            .agg(*[column.alias(f"m{i}") for i, column in enumerate(sums)])
        )
        n = rows.agg(F.count("*").alias("n")).scalar()
        coefficients = self.coefficients.withColumnRenamed("term_id", "of_term")
        moments = F.arrays_zip(
            names.alias("label"),
            F.array(*[F.col(f"m{i}") for i in range(len(self.labels))]).alias("moment"),
            F.coalesce(
                "coefficients", F.array_repeat(F.lit(0.0), len(self.labels))
            ).alias("coefficient"),
        )
        found = per_term.join(
            bounded_broadcast(coefficients, self.max_features),
            F.col("term_id") == F.col("of_term"),
            "left",
        ).select("term_id", F.explode(moments).alias("of"))
        return found.select(
            F.col("of.label").alias("label"),
            "term_id",
            F.col("of.moment.held").alias("held"),
            (
                (F.col("of.moment.expected") - F.col("of.moment.held")) / n
                + self.penalty * F.col("of.coefficient")
            ).alias("gradient"),
        )


# How a vector column lies in a file: its own kind is read over plain columns of this shape.
SPARSE = 0


def sparse_vectors(entries: DataFrame, label: str, size: int) -> DataFrame:
    """(label, features): ``entries`` (term_id, w), sorted by term, as vectors of length ``size``.

    The columns of a vector are written as what they are and read again as a vector, so no row
    passes through Python.
    """
    plain = F.struct(
        F.lit(SPARSE).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.col("entries.term_id").cast("array<int>").alias("indices"),
        F.col("entries.w").cast("array<double>").alias("values"),
    )
    return cut_lineage(
        entries.select(F.col(label).cast("double").alias("label"), plain.alias("features")),
        T.StructType(
            [T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())]
        ),
    )


def fit_text_classifier(
    training: DataFrame,
    key: str = "msg_id",
    text: str = "message",
    label: str = "label",
    max_features: int = fixed.BASELINE_MAX_FEATURES,
    c: float = 1.0,
    max_iter: int = 1000,
    stop_words: list[str] | None = None,
) -> TextClassifier:
    """Fit on (key, text, label) with an L2 penalty of 1/(c n) and free intercepts.

    All rows that have a key are learned from.
    """
    spark = training.sparkSession
    training = training.where(F.col(key).isNotNull())
    if stop_words is None:
        stop_words = list(ENGLISH)
    rows = cut_lineage(
        training.select(
            key, F.coalesce(F.col(text), F.lit("")).alias("text"), label,
            F.lit(1).alias("copies"),
        )
    )
    # Texts are counted twice, first for the vocabulary, then for its terms only: the rare terms of a
    # large table are neither written nor moved by row.
    texts = together(rows.select(key, "text", "copies"), key)
    every = term_counts(texts, key, stop_words)
    documents = rows.agg(F.count("*").alias("n"))
    vocab = settle(spark, lambda: vocabulary(every, documents, max_features))
    counts = term_counts(texts, key, stop_words, vocab, max_features)
    found = rows.select(label).distinct().orderBy(label).limit(MAX_LABELS + 1).collect()
    labels = [r[0] for r in found]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: {label} is no taxonomy")
    size = vocab.count()
    vectors = weights(counts, key, vocab, max_features).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("entries")
    )
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    none = F.array().cast("array<struct<term_id:int,w:double>>")
    features = sparse_vectors(
        rows.join(vectors, key, "left").select(
            index.alias("class"), F.coalesce("entries", none).alias("entries")
        ),
        "class",
        size,
    )
    n, amount = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if len(labels) == 1:
        schema = "term_id int, coefficients array<double>"
        return TextClassifier(
            vocab, spark.createDataFrame([], schema), [0.0], labels, max_features, stop_words
        )
    penalty = 1.0 / (c * n)
    model = LogisticRegression(
        family="multinomial", maxIter=max_iter, regParam=penalty, standardization=False,
        tol=TOLERANCE,
    ).fit(features.coalesce(max(1, -(-amount // FIT_TEXT_PER_TASK))))
    matrix = model.coefficientMatrix.toArray()
    coefficients = spark.createDataFrame(
        [(i, matrix[:, i].tolist()) for i in range(size)],
        T.StructType(
            [
                T.StructField("term_id", T.IntegerType()),
                T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            ]
        ),
    )
    return TextClassifier(
        vocab, coefficients, model.interceptVector.toArray().tolist(), labels, max_features,
        stop_words, penalty,
    )
