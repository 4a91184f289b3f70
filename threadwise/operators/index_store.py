"""Persisting the retrieval index as Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.operators.tfidf import (
    TfidfIndex,
    build_index,
    champions,
    term_impacts,
    with_buckets,
)
from threadwise.rules import fixed_values as fixed


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str) -> TfidfIndex:
    """The version that was completed last."""
    settings = _read(spark, folder, "settings").orderBy(F.desc("written_at"), "version").first()
    version = f"{folder}/{settings.version}"
    tables = {name: _read(spark, version, name) for name in TfidfIndex.TABLES}
    return TfidfIndex(
        **tables, max_features=settings.max_features, stop_words=list(settings.stop_words)
    )


def save_index(index: TfidfIndex, folder: str) -> TfidfIndex:
    """Write a new version, then the row of ``settings`` that makes it the current one.

    Every table is written once, each derived from the ones already written. A job that fails on
    the way leaves the earlier version in use. Postings lie in a folder per range of terms, in the
    order of their terms: a few queries read the folders of their own terms and no others. Old
    versions stay until the folder is cleaned.
    """
    spark = index.postings.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    version = f"{folder}/{name}"
    index.vocab.write.parquet(f"{version}/vocab")
    by_term = index.postings.repartitionByRange("term_id", "doc")
    by_term = with_buckets(by_term.sortWithinPartitions("term_id", "doc"))
    by_term.write.partitionBy("bucket").parquet(f"{version}/postings")
    index.records.write.parquet(f"{version}/records")
    index.vectors.write.parquet(f"{version}/vectors")
    postings = _read(spark, version, "postings")
    term_impacts(postings).write.parquet(f"{version}/impacts")
    champions(postings).write.parquet(f"{version}/champions")
    settings = spark.range(1).select(
        F.lit(name).alias("version"),
        F.current_timestamp().alias("written_at"),
        F.lit(index.max_features).alias("max_features"),
        F.array(*[F.lit(word) for word in index.stop_words])
        .cast("array<string>")
        .alias("stop_words"),
    )
    settings.write.mode("append").parquet(f"{folder}/settings")
    return load_index(spark, folder)


def ensure_index(
    corpus: DataFrame,
    folder: str,
    force: bool = False,
    max_features: int = fixed.MAX_FEATURES,
    stop_words: list[str] | None = None,
) -> TfidfIndex:
    """Load the index in ``folder``; build and save it first if absent or ``force`` is set."""
    spark = corpus.sparkSession
    if not force:
        try:
            return load_index(spark, folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return save_index(
        build_index(corpus, max_features=max_features, stop_words=stop_words), folder
    )
