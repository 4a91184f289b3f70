"""The registered queries: each applies its operator to a whole table and returns its contract."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadwise.llm import (
    bitplanes,
    hard_negatives,
    license_scan,
    line_quality,
    merkle,
    mixing,
    onebit_search,
    page_text,
    pieces,
    pii,
    simhash,
    token_counts,
    toxicity,
)
from threadwise.llm.common import table
from threadwise.session import cut_lineage, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of every document and whether the line rules keep it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_quality.with_verdict(docs).select("doc_id", *line_quality.MEASURES, "kept")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encoded(docs, path, check=True).select("doc_id", "n_tokens", "ids", "decoded")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all documents takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = cut_lineage(mixing.measure(docs).drop("text"))
    return mixing.mix(measured).select("doc_id", "size", "source_size", "target", "taken")


END_ID = 2


def op1_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the files of planes, and their checksum, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    bitplanes.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return bitplanes.read_digests(spark, path)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_pii(docs).select("doc_id", *pii.FOUND.names)


def op6_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    index = onebit_search.build_index(table(spark, sf_dir, "embeddings"))
    return onebit_search.search(index, index.filter("vec_id % 20 = 0"), k=20)


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.with_text(pages).select("page_id", "url", "text", "n_chars")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, learned from the training part of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = toxicity.scored(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of near copies it belongs to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fingerprinted = cut_lineage(simhash.with_fingerprint(docs).drop("text"))
    return simhash.near_duplicates(fingerprinted).select(
        "doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.drop("text")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence phrases and accepted licence templates of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.with_licenses(docs).drop("text", "matches")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether its row still folds up to the root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.with_proofs(docs, tampered="crc32(CAST(doc_id AS STRING)) % 3 = 0")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every positive of the vectors whose id is divisible by 100."""
    label = "IF(vec_id % 7 = 0, (CAST(label AS LONG) + 1) % 10, CAST(label AS LONG)) AS label"
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", label)
    return hard_negatives.mined(hard_negatives.quantised(vectors), "vec_id % 100 = 0")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_bitplanes,
        op2_pii,
        op3_line_quality,
        op4_pieces,
        op5_mixing,
        op6_onebit_search,
        op7_page_text,
        op8_toxicity,
        op9_simhash,
        op10_token_counts,
        op11_license_scan,
        op12_merkle,
        op13_hard_negatives,
    )
}
