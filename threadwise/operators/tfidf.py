"""TF-IDF over tables of texts: vocabulary, weights and the index tables.

Copies of a text share one vector: the smallest id stands for the group (``doc``), and counts
are weighted by the number of copies. The vocabulary is capped by ``max_features``, which also
bounds every per-term table below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwise.functions.arrays import explode_computed
from threadwise.functions.text import drop_words, unigrams_and_bigrams, word_tokens
from threadwise.rules import fixed_values as fixed
from threadwise.rules.stop_words import ENGLISH
from threadwise.session import cut_lineage, settle, task_count

# Per-term tables up to this many rows are broadcast.
BROADCAST_ROWS = 1_000_000
# Documents remembered per term, heaviest first; lists of up to this many results begin with a
# prefix of them, longer ones read the postings.
CHAMPIONS = 128
# Postings are laid out by ranges of so many terms.
TERMS_PER_BUCKET = 128
# Bytes of text whose words and pairs are counted by one task, all in memory.
TEXT_PER_TASK = 4_000_000
# Selections up to this size are kept as the best of each task; larger ones begin with a histogram.
HEAP_ROWS = 100_000
# Counts are histogrammed in this many steps per factor of two.
STEPS_PER_OCTAVE = 16


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` when its row bound is small; otherwise let Spark choose."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_terms(texts: DataFrame, stop_words: list[str], text: str = "text") -> DataFrame:
    """Add ``terms``: words without stop words, then adjacent pairs."""
    # A projection of its own keeps the tokens from being recomputed inside the pairing.
    tokens = drop_words(word_tokens(F.col(text)), stop_words)
    return (
        texts.withColumn("tokens", tokens)
        .withColumn("terms", unigrams_and_bigrams(F.col("tokens")))
        .drop("tokens")
    )


def evidence_corpus(conversations: DataFrame) -> DataFrame:
    """Conversations usable as evidence: replied to, with both texts present."""
    return conversations.where(
        F.col("has_support_reply")
        & (F.coalesce("initial_query", F.lit("")) != "")
        & (F.coalesce("first_support_reply", F.lit("")) != "")
    )


def distinct_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, copies): one row per text, keyed by its smallest id."""
    return texts.groupBy(F.col(text).alias("text")).agg(
        F.min(key).alias(key), F.count("*").alias("copies")
    )


def text_key(text: Column) -> Column:
    """A digest that stands for a text in joins."""
    return F.sha2(text, 256)


def together(distinct: DataFrame, key: str) -> DataFrame:
    """(key, text, copies) with the rows of a key in one task, so that its terms need not move."""
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return distinct.repartition(task_count(distinct, size, TEXT_PER_TASK), key)


def term_counts(
    distinct: DataFrame, key: str, stop_words: list[str], vocab: DataFrame | None = None,
    max_features: int = fixed.MAX_FEATURES,
) -> DataFrame:
    """(key, copies, term, tf) for a table of distinct texts, of the terms in ``vocab`` if given."""
    exploded = explode_computed(
        with_terms(distinct, stop_words), F.col("terms"), "term", key, "copies"
    )
    if vocab is not None:
        kept = bounded_broadcast(vocab.select("term"), max_features)
        exploded = exploded.join(kept, "term", "left_semi")
    return exploded.groupBy(key, "term").agg(
        F.max("copies").alias("copies"), F.count("*").alias("tf")
    )


def count_bucket(count: Column) -> Column:
    return F.floor(F.log2(count) * STEPS_PER_OCTAVE).cast("int")


def most_frequent(counted: DataFrame, count: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest ``count``, ties by ``tie``.

    Few rows are selected in one pass, by a heap in each task. For many, a histogram of the counts
    first finds a floor that at least ``n`` rows pass, so the final sort sees little more than ``n``
    rows however long the tail is; ``counted`` is written for that, as it is read twice.
    """
    if n <= HEAP_ROWS:
        return counted.orderBy(F.desc(count), F.asc(tie)).limit(n)
    counted = cut_lineage(counted)
    bucket = count_bucket(F.col(count))
    histogram = counted.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"))
    # At most a few hundred buckets exist, so this window is small by construction.
    passing = histogram.withColumn(
        "passing", F.sum("rows").over(Window.orderBy(F.desc("bucket")))
    )
    floor = passing.agg(
        F.coalesce(
            F.max(F.when(F.col("passing") >= n, F.col("bucket"))), F.min("bucket")
        ).alias("floor")
    )
    return (
        counted.where(bucket >= floor.scalar()).orderBy(F.desc(count), F.asc(tie)).limit(n)
    )


def vocabulary(counts: DataFrame, documents: DataFrame, max_features: int) -> DataFrame:
    """(term, term_id, cf, df, idf) of the ``max_features`` most frequent terms.

    ``documents`` is a one-row, one-column table holding the number of documents.
    """
    per_term = counts.groupBy("term").agg(
        F.sum(F.col("tf") * F.col("copies")).alias("cf"), F.sum("copies").alias("df")
    )
    kept = most_frequent(per_term, "cf", "term", max_features)
    size = documents.scalar()
    # The window covers the capped vocabulary only.
    return kept.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"),
        "cf",
        "df",
        (F.log((1 + size) / (1 + F.col("df"))) + 1).alias("idf"),
    )


def weights(counts: DataFrame, key: str, vocab: DataFrame, max_features: int) -> DataFrame:
    """(key, term_id, w): sublinear TF times IDF, each document scaled to unit length.

    Terms outside the vocabulary are dropped, so this also transforms new texts.
    """
    raw = counts.join(
        bounded_broadcast(vocab.select("term", "term_id", "idf"), max_features), "term"
    ).select(key, "term_id", ((1 + F.log(F.col("tf"))) * F.col("idf")).alias("raw"))
    # A document holds at most max_features terms, which bounds each window.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term_id", (F.col("raw") / norm).alias("w"))


def term_impacts(postings: DataFrame) -> DataFrame:
    """(term_id, docs, max_w): how many vectors hold a term and its largest weight."""
    return postings.groupBy("term_id").agg(
        F.count("*").alias("docs"), F.max("w").alias("max_w")
    )


def champions(postings: DataFrame, per_term: int = CHAMPIONS) -> DataFrame:
    """(term_id, doc, w, place): the documents in which each term weighs most, heaviest first."""
    rank = F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("w"), "doc"))
    return (
        postings.withColumn("place", rank)
        .where(F.col("place") <= per_term)
        .select("term_id", "doc", "w", "place")
    )


def term_bucket(term_id: Column) -> Column:
    """The range of terms that a posting is stored with."""
    return F.floor(term_id / TERMS_PER_BUCKET).cast("int")


def with_buckets(postings: DataFrame) -> DataFrame:
    return postings.withColumn("bucket", term_bucket(F.col("term_id")))


def document_vectors(postings: DataFrame) -> DataFrame:
    """(doc, terms, weights): a document's postings in one row, at most one entry per term."""
    entry = F.struct("term_id", "w")
    entries = postings.groupBy("doc").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return entries.select(
        "doc", F.col("entries.term_id").alias("terms"), F.col("entries.w").alias("weights")
    )


def vector_postings(vectors: DataFrame) -> DataFrame:
    """(doc, term_id, w): the entries of document vectors as rows."""
    entries = F.arrays_zip(F.col("terms").alias("term_id"), F.col("weights").alias("w"))
    return vectors.select("doc", F.inline(entries))


@dataclass
class TfidfIndex:
    """The index as tables. ``records`` maps every corpus row to the vector (``doc``) it shares.

    Weights are there twice: by term and its bucket as ``postings``, by document as ``vectors``.
    """

    vocab: DataFrame
    postings: DataFrame
    vectors: DataFrame
    impacts: DataFrame
    champions: DataFrame
    records: DataFrame
    max_features: int
    stop_words: list[str]

    TABLES = ("vocab", "postings", "vectors", "impacts", "champions", "records")

    def champion_lists(self, terms: DataFrame, per_term: int) -> DataFrame:
        """(term_id, doc, dw): the heaviest documents of ``terms`` (term_id), so many of each.

        Prefixes of the stored lists, or, beyond their length, of the postings themselves.
        """
        asked = bounded_broadcast(terms.select("term_id").distinct(), self.max_features)
        if per_term <= CHAMPIONS:
            found = self.champions.where(F.col("place") <= per_term).join(asked, "term_id")
        else:
            held = self.postings.join(asked, "term_id", "left_semi")
            found = champions(held, per_term)
        return found.select("term_id", "doc", F.col("w").alias("dw"))


def build_index(
    corpus: DataFrame,
    text: str = "initial_query",
    doc: str = "conversation_id",
    max_features: int = fixed.MAX_FEATURES,
    stop_words: list[str] | None = None,
) -> TfidfIndex:
    """Index the texts of ``corpus``; its other columns are kept as the records."""
    if stop_words is None:
        stop_words = list(ENGLISH)
    # Texts are written once and counted twice, first for the vocabulary, then for its terms only:
    # the rare terms, nearly all of a large table's, are neither written nor moved by document.
    distinct = cut_lineage(distinct_texts(corpus, doc, text).withColumnRenamed(doc, "doc"))
    size = corpus.agg(F.count("*").alias("n"))
    every = term_counts(together(distinct, "doc"), "doc", stop_words)
    vocab = settle(corpus.sparkSession, lambda: vocabulary(every, size, max_features))
    counts = term_counts(together(distinct, "doc"), "doc", stop_words, vocab, max_features)
    vectors = cut_lineage(document_vectors(weights(counts, "doc", vocab, max_features)))
    postings = vector_postings(vectors)
    keyed = distinct.select("doc", text_key(F.col("text")).alias("text_key"))
    records = (
        corpus.withColumnRenamed(doc, "record_id")
        .withColumn("text_key", text_key(F.col(text)))
        .join(keyed, "text_key")
        .drop("text_key")
    )
    return TfidfIndex(
        vocab,
        with_buckets(postings),
        vectors,
        cut_lineage(term_impacts(postings)),
        cut_lineage(champions(postings)),
        records,
        max_features,
        stop_words,
    )


def transform(texts: DataFrame, key: str, text: str, index: TfidfIndex) -> DataFrame:
    """Weights of new texts under the index's vocabulary; ``texts`` must be distinct by key."""
    rows = texts.select(key, F.col(text).alias("text"), F.lit(1).alias("copies"))
    counts = term_counts(rows, key, index.stop_words, index.vocab, index.max_features)
    return weights(counts, key, index.vocab, index.max_features)
