"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's documents. All but the last return the columns of ``documents``. A stage's decisions
take effect: rejected documents, frequent lines and near copies go, personal data is masked, the mix drops or
repeats documents, and the last stage returns the ids a model is trained on.

The quality stage takes frequent lines out of the texts it keeps, so later stages never see them.
Nulls, empty texts, empty tables and extra columns behave as each operator documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadwise.llm import line_quality, mixing, pieces, pii, simhash
from threadwise.session import configure, cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids")


def _configured(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _configured(quality_rules)),
    ("simhash_near_dedup", _configured(near_duplicates)),
    ("pii", _configured(personal_data)),
    ("mixing", _configured(source_mix)),
    ("sentencepiece", _configured(piece_ids)),
]

# Fingerprints and piece ids have no SQL form; the tests compare the rows with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *early, (_, last) = STAGES
    for _, stage in early:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
