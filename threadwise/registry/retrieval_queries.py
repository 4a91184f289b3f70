"""TF-IDF and similarity search (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwise.functions import text
from threadwise.operators import similarity, tfidf
from threadwise.registry import inputs
from threadwise.registry import sqltext as sql
from threadwise.registry.catalog import query
from threadwise.registry.inputs import SUPPORT_CONVERSATIONS
from threadwise.rules import fixed_values as fixed
from threadwise.rules.stop_words import ENGLISH

_DOCS = sql.tfidf("documents", "doc_id", "text")
_SUPPORT = sql.with_(SUPPORT_CONVERSATIONS, sql.support_retrieval())


def _documents(spark, sf_dir):
    return inputs.texts(spark, sf_dir, "documents").select("doc_id", "text")


def _names(index):
    """(term_id, term), small because the vocabulary is capped."""
    return tfidf.bounded_broadcast(index.vocab.select("term_id", "term"), index.max_features)


def _evidence(spark, sf_dir, **options):
    return similarity.retrieve(
        inputs.messages(spark, sf_dir), inputs.support_index(spark, sf_dir), **options
    )


@query(
    sql.with_(SUPPORT_CONVERSATIONS)
    + "\nSELECT conversation_id, initial_query, first_support_reply FROM corpus"
)
def e1_evidence_corpus(spark, sf_dir):
    corpus = tfidf.evidence_corpus(inputs.support_conversations(spark, sf_dir))
    return corpus.select("conversation_id", "initial_query", "first_support_reply")


@query(
    r"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ' ') AS tokens
FROM documents"""
)
def e2_word_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", F.array_join(text.word_tokens(F.col("text")), " ").alias("tokens")
    )


@query(f"SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS tokens FROM documents")
def e3_drop_stop_words(spark, sf_dir):
    kept = text.drop_words(text.word_tokens(F.col("text")), list(ENGLISH))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query(
    f"WITH t AS (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)"
    + """
SELECT doc_id, array_to_string(list_concat(t, list_transform(range(1, len(t)),
       lambda i: t[i] || ' ' || t[i + 1])), '|') AS terms FROM t"""
)
def e4_terms(spark, sf_dir):
    terms = tfidf.with_terms(_documents(spark, sf_dir), list(ENGLISH))
    return terms.select("doc_id", F.array_join("terms", "|").alias("terms"))


@query(sql.with_(_DOCS) + "\nSELECT term, cf FROM vocab")
def e5_vocabulary(spark, sf_dir):
    return inputs.document_index(spark, sf_dir).vocab.select("term", "cf")


@query(sql.with_(_DOCS) + "\nSELECT term, df, round(idf, 6) AS idf FROM vocab")
def e6_idf(spark, sf_dir):
    vocab = inputs.document_index(spark, sf_dir).vocab
    return vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    sql.with_(_DOCS)
    + """
SELECT doc_id, term, tf, round(1 + ln(tf), 6) AS sublinear FROM doc_counts JOIN vocab USING (term)"""
)
def e7_term_frequency(spark, sf_dir):
    # Rare terms, nearly all of a large table's, are dropped before they are counted and moved.
    rows = inputs.read(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1).alias("copies"))
    vocab = inputs.document_index(spark, sf_dir).vocab.select("term")
    counts = tfidf.term_counts(
        tfidf.together(rows, "doc_id"), "doc_id", list(ENGLISH), vocab, fixed.MAX_FEATURES
    )
    return counts.select(
        "doc_id", "term", "tf", F.round(1 + F.log("tf"), 6).alias("sublinear")
    )


@query(sql.with_(_DOCS) + "\nSELECT doc_id, term, round(w, 6) AS w FROM doc_weights")
def e8_unit_weights(spark, sf_dir):
    index = inputs.document_index(spark, sf_dir)
    # Copies share one vector; list it once per document.
    return (
        index.records.select(F.col("record_id").alias("doc_id"), "doc")
        .join(index.postings, "doc")
        .join(_names(index), "term_id")
        .select("doc_id", "term", F.round("w", 6).alias("w"))
    )


@query(_SUPPORT + "\nSELECT msg_id, term, round(w, 6) AS w FROM query_weights")
def e9_query_weights(spark, sf_dir):
    index = inputs.support_index(spark, sf_dir)
    weights = tfidf.transform(inputs.messages(spark, sf_dir), "msg_id", "message", index)
    return weights.join(_names(index), "term_id").select(
        "msg_id", "term", F.round("w", 6).alias("w")
    )


@query(
    _SUPPORT
    + """
SELECT m.msg_id, c.conversation_id, round(coalesce(p.similarity, 0), 6) AS similarity
FROM messages m JOIN corpus c ON c.conversation_id = m.conv_id
LEFT JOIN pair_scores p ON p.msg_id = m.msg_id AND p.conversation_id = c.conversation_id"""
)
def e10_cosine_similarity(spark, sf_dir):
    """How close each message stays to the opening message of its own conversation."""
    index = inputs.support_index(spark, sf_dir)
    messages = inputs.messages(spark, sf_dir)
    corpus = index.records.select(F.col("record_id").alias("conversation_id"), "doc")
    pairs = messages.select("msg_id", F.col("conv_id").alias("conversation_id")).join(
        corpus, "conversation_id"
    )
    left = tfidf.transform(messages, "msg_id", "message", index)
    scored = similarity.cosine_pairs(
        pairs.select("msg_id", "doc").distinct(), left, index.postings, "msg_id", "doc"
    )
    return pairs.join(scored, ["msg_id", "doc"]).select(
        "msg_id", "conversation_id", F.round("similarity", 6).alias("similarity")
    )


RETRIEVED_SQL = (
    _SUPPORT
    + "\nSELECT msg_id, conversation_id, rank, round(similarity, 6) AS similarity FROM retrieved"
)


@query(RETRIEVED_SQL)
def e11_retrieve_topk(spark, sf_dir):
    return _evidence(spark, sf_dir, columns=[]).select(
        "msg_id",
        F.col("record_id").alias("conversation_id"),
        F.col("rank").cast("long").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )


@query(
    sql.with_(
        sql.retrieval("documents", "doc_id", "text", "benchmark", "item_id", "text", 5)
    )
    + "\nSELECT item_id, doc_id, rank, similarity_score FROM retrieved"
)
def e11_benchmark_topk(spark, sf_dir):
    found = similarity.retrieve(
        inputs.texts(spark, sf_dir, "benchmark"), inputs.document_index(spark, sf_dir),
        "item_id", "text", columns=[],
    )
    return found.select(
        "item_id",
        F.col("record_id").alias("doc_id"),
        F.col("rank").cast("long").alias("rank"),
        "similarity_score",
    )


@query(
    sql.with_(
        sql.retrieval("documents", "doc_id", "text", "benchmark", "item_id", "text", 5)
    ).replace("similarity >= 0.01", "similarity >= 0.1")
    + "\nSELECT item_id, count(*) AS kept, max(similarity_score) AS best FROM retrieved GROUP BY ALL"
)
def e12_score_floor(spark, sf_dir):
    found = similarity.retrieve(
        inputs.texts(spark, sf_dir, "benchmark"), inputs.document_index(spark, sf_dir),
        "item_id", "text", min_score=0.1, columns=[],
    )
    return found.groupBy("item_id").agg(
        F.count("*").alias("kept"), F.max("similarity_score").alias("best")
    )


@query(
    _SUPPORT
    + """
SELECT r.msg_id, r.rank, r.similarity_score, c.conversation_id, c.initial_query,
       c.first_support_reply, c.customer_id, c.num_turns
FROM retrieved r JOIN corpus c USING (conversation_id)"""
)
def e13_evidence_records(spark, sf_dir):
    columns = ["initial_query", "first_support_reply", "customer_id", "num_turns"]
    return _evidence(spark, sf_dir, columns=columns).select(
        "msg_id", F.col("rank").cast("long").alias("rank"), "similarity_score",
        F.col("record_id").alias("conversation_id"), *columns,
    )


@query(
    _SUPPORT
    + """
SELECT m.msg_id, count(r.rank) AS cases, coalesce(max(r.similarity_score), 0.0) AS best_similarity,
       coalesce(string_agg(CAST(r.conversation_id AS VARCHAR), '|' ORDER BY r.rank), '') AS case_ids
FROM messages m LEFT JOIN retrieved r USING (msg_id) GROUP BY m.msg_id"""
)
def e14_attach_evidence(spark, sf_dir):
    nested = similarity.attach_evidence(
        inputs.messages(spark, sf_dir), inputs.support_index(spark, sf_dir)
    )
    return nested.select(
        "msg_id",
        F.size("evidence").cast("long").alias("cases"),
        "best_similarity",
        F.array_join(
            F.transform("evidence", lambda e: e["record_id"].cast("string")), "|"
        ).alias("case_ids"),
    )
