"""Retrieval against a brute-force computation on random fixtures."""

import math
import random
import re
from collections import Counter

import pytest
from conftest import TESTDATA

from threadwise import session
from threadwise.operators import index_store, similarity, tfidf
from threadwise.session import cut_lineage

STOP = ["the", "and"]


def grams(text):
    words = [w for w in text.lower().split() if len(w) >= 2 and w not in STOP]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(corpus, queries, k, max_features, min_score):
    counts = {i: Counter(grams(t)) for i, t in corpus}
    total = Counter()
    df = Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((1 + len(corpus)) / (1 + df[t])) + 1 for t in vocab}

    def vector(c):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    docs = {i: vector(c) for i, c in counts.items()}
    result = {}
    for q, text in queries:
        v = vector(Counter(grams(text)))
        scores = [
            (round(sum(w * d[t] for t, w in v.items() if t in d), 10), i) for i, d in docs.items()
        ]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:k]
        result[q] = [(i, round(s, 4)) for s, i in best if s >= min_score]
    return result


def random_texts(seed, n, vocabulary, length, copies=0.0):
    """Zipf-like words, so that one word sits in most texts; some texts are exact copies."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    texts = []
    for i in range(n):
        if texts and draw.random() < copies:
            texts.append((i, texts[0][1]))
        else:
            size = draw.randint(1, length)
            texts.append((i, " ".join(draw.choices(words, weights, k=size))))
    return texts


@pytest.mark.parametrize(
    "seed, vocabulary, length, max_features, k, min_score",
    [
        (1, 30, 6, 1000, 5, 0.01),
        (2, 200, 25, 150, 3, 0.01),
        (3, 8, 3, 1000, 1, 0.3),
        (4, 60, 12, 40, 20, 0.05),
    ],
)
def test_equals_brute_force(spark, seed, vocabulary, length, max_features, k, min_score):
    corpus = random_texts(seed, 150, vocabulary, length, copies=0.35)
    queries = random_texts(seed + 100, 40, vocabulary + 5, length, copies=0.35) + [(99, "zz the")]
    index = tfidf.build_index(
        spark.createDataFrame(corpus, "id long, body string"), "body", "id", max_features, STOP
    )
    found = similarity.retrieve(
        spark.createDataFrame(queries, "msg_id long, message string"), index, k=k,
        min_score=min_score, columns=[],
    )
    got = {q: [] for q, _ in queries}
    for row in found.orderBy("msg_id", "rank").collect():
        got[row.msg_id].append((row.record_id, row.similarity_score))
    assert got == brute_force(corpus, queries, k, max_features, min_score)


def test_postings_of_hot_terms_are_split(spark, monkeypatch):
    monkeypatch.setattr(similarity, "POSTINGS_PER_KEY", 10)
    test_equals_brute_force(spark, 5, 30, 6, 1000, 5, 0.01)


@pytest.mark.parametrize("k", [100, 300])
def test_long_lists_equal_brute_force(spark, k):
    """Beyond the first champions, and beyond the stored ones."""
    test_equals_brute_force(spark, 6, 40, 8, 1000, k, 0.01)


def test_candidates_stay_few_whatever_k_is(spark):
    """Floors exist for long lists too, so pruning does not fall away."""
    corpus = random_texts(11, 4000, 400, 12)
    queries = random_texts(12, 40, 400, 8)
    index = tfidf.build_index(
        spark.createDataFrame(corpus, "id long, body string"), "body", "id", 5000, STOP
    )
    texts = spark.createDataFrame(queries, "q long, text string")
    query = cut_lineage(tfidf.transform(texts, "q", "text", index))
    every = query.join(index.postings.select("doc", "term_id"), "term_id")
    every = every.select("q", "doc").distinct().count()
    pairs = {}
    for k in (5, 20, 100):
        plan = cut_lineage(similarity._query_plan(query, index, k, 0.01))
        assert plan.where("floor < 0.01").select("q").distinct().count() <= 4
        pairs[k] = similarity.candidate_pairs(plan, index).count()
    assert pairs[5] <= pairs[20] <= pairs[100] < every / 3, (pairs, every)


def test_pairs_that_leave_a_task_are_bounded(spark, monkeypatch):
    """All texts share their words: every pair is a candidate, k per query and block go on."""
    monkeypatch.setattr(similarity, "POSTINGS_PER_KEY", 800)
    corpus = [(i, f"red fox runs far w{i % 7}") for i in range(0, 400)]
    corpus = [(i, f"{text} v{i}") for i, text in corpus]
    index = tfidf.build_index(
        spark.createDataFrame(corpus, "id long, body string"), "body", "id", 60, STOP
    )
    texts = spark.createDataFrame([(q, f"red fox runs w{q}") for q in range(9)], "q long, text string")
    query = cut_lineage(tfidf.transform(texts, "q", "text", index))
    plan = cut_lineage(similarity._query_plan(query, index, 5, 0.01))
    blocks = -(-index.impacts.agg({"docs": "sum"}).first()[0] // 800)
    pairs = similarity.candidate_pairs(plan, index, 5)
    found = pairs.groupBy("q").count().collect()
    assert blocks > 2 and len(found) == 9
    assert all(5 <= row["count"] <= 5 * blocks for row in found)


def test_vectors_are_not_dealt_to_pairs_of_blocks(spark, monkeypatch):
    """Many blocks on both sides: the lists are the same, and no vector is repeated for a shuffle."""
    monkeypatch.setattr(similarity, "POSTINGS_PER_KEY", 60)
    monkeypatch.setattr(similarity, "TERMS_PER_KEY", 30)
    corpus = random_texts(21, 60, 40, 6, copies=0.2)
    queries = random_texts(22, 30, 40, 6, copies=0.2)
    index = tfidf.build_index(
        spark.createDataFrame(corpus, "id long, body string"), "body", "id", 300, STOP
    )
    texts = spark.createDataFrame(queries, "q long, text string")
    query = cut_lineage(tfidf.transform(texts, "q", "text", index))
    plan = cut_lineage(similarity._query_plan(query, index, 3, 0.01))
    pairs = similarity.candidate_pairs(plan, index, 3)
    steps = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in steps and "Exchange" not in steps and "Generate" not in steps
    vectors = {}
    for row in query.collect():
        vectors.setdefault(row.q, {})[row.term_id] = row.w
    docs = {r.doc: dict(zip(r.terms, r.weights)) for r in index.vectors.collect()}
    best = {}
    for q, v in vectors.items():
        scores = [(-round(sum(w * d.get(t, 0) for t, w in v.items()), 10), i) for i, d in docs.items()]
        best[q] = [(i, -s) for s, i in sorted(scores)[:3] if -s >= 0.01]
    found = {}
    for row in similarity.best_vectors(query, index, 3, 0.01).orderBy("q", "score").collect():
        found.setdefault(row.q, []).append((row.doc, row.score))
    for q, rows in found.items():
        assert sorted(rows, key=lambda r: (-r[1], r[0])) == [(i, pytest.approx(s)) for i, s in best[q]]
    assert set(found) == {q for q, rows in best.items() if rows}


def test_repeated_and_missing_ids(spark):
    corpus = [(1, "red fox"), (1, "blue owl"), (None, "red owl"), (2, "red fox")]
    index = tfidf.build_index(
        spark.createDataFrame(corpus, "id long, body string"), "body", "id", 100, STOP
    )
    messages = spark.createDataFrame(
        [(7, "red fox"), (7, "blue owl"), (None, "owl")], "msg_id long, message string"
    )
    found = similarity.retrieve(messages, index, columns=[]).collect()
    assert {r.msg_id for r in found} == {7} and {r.record_id for r in found} <= {1, 2}


def test_counts_of_a_vocabulary(spark):
    """Only its terms are counted by document, and as often as without it."""
    texts = spark.createDataFrame(
        [(1, "red red fox", 2), (2, "fox owl", 1)], "doc long, text string, copies long"
    )
    every = {tuple(r) for r in tfidf.term_counts(texts, "doc", STOP).collect()}
    vocab = spark.createDataFrame([("red",), ("fox owl",)], "term string")
    some = {tuple(r) for r in tfidf.term_counts(texts, "doc", STOP, vocab).collect()}
    assert some == {row for row in every if row[1] in ("red", "fox owl")} and len(some) == 2
    assert {tuple(r) for r in tfidf.term_counts(tfidf.together(texts, "doc"), "doc", STOP).collect()} == every


def test_no_join_on_documents_and_terms(spark):
    corpus = random_texts(13, 60, 30, 6)
    index = tfidf.build_index(
        spark.createDataFrame(corpus, "id long, body string"), "body", "id", 100, STOP
    )
    texts = spark.createDataFrame([(1, corpus[0][1])], "q long, text string")
    found = similarity.best_vectors(tfidf.transform(texts, "q", "text", index), index, 5, 0.01)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    both = [j for j in joins if re.search(r"doc#\w+ = doc#", j) and re.search(r"term_id#\w+ = term_id#", j)]
    assert joins and not both


def test_stored_postings_are_read_by_the_terms_asked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tfidf, "TERMS_PER_BUCKET", 4)
    corpus = random_texts(14, 120, 60, 6)
    built = tfidf.build_index(
        spark.createDataFrame(corpus, "id long, body string"), "body", "id", 200, STOP
    )
    index = index_store.save_index(built, str(tmp_path / "index"))
    assert len(list((tmp_path / "index").glob("version-*/postings/bucket=*"))) > 10
    texts = spark.createDataFrame([(1, corpus[3][1])], "q long, text string")
    plan = cut_lineage(
        similarity._query_plan(tfidf.transform(texts, "q", "text", index), index, 3, 0.01)
    )
    pairs = similarity.candidate_pairs(plan, index)
    assert "dynamicpruning" in pairs._jdf.queryExecution().executedPlan().toString()
    messages = spark.createDataFrame(corpus[:20], "msg_id long, message string")
    stored, fresh = (
        sorted(map(tuple, similarity.retrieve(messages, x, k=3, columns=[]).collect()))
        for x in (index, built)
    )
    assert stored == fresh


def test_most_frequent_ties_and_tail(spark):
    rows = [(f"t{i:03d}", 1 + (i % 4 == 0) * 5 + (i == 7) * 100) for i in range(200)]
    counted = spark.createDataFrame(rows, "term string, cf long")
    for n in (1, 10, 60, 500):
        got = [r.term for r in tfidf.most_frequent(counted, "cf", "term", n).collect()]
        assert got == [t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:n]]


def test_large_selections_begin_with_a_histogram(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "HEAP_ROWS", 0)
    test_most_frequent_ties_and_tail(spark)


def test_index_of_documents_moves_no_terms(spark):
    """Terms lie with their document already: nothing but texts and the vocabulary is shuffled."""
    texts = spark.createDataFrame([(1, "red fox", 1), (2, "blue owl", 1)], "doc long, text string, copies long")
    vocab = spark.createDataFrame([("red", 0, 1.0), ("owl", 1, 1.0)], "term string, term_id int, idf double")
    counts = tfidf.term_counts(tfidf.together(texts, "doc"), "doc", STOP, vocab)
    vectors = tfidf.document_vectors(tfidf.weights(counts, "doc", vocab, 10))
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.doc, *r.terms) for r in vectors.collect()} == {(1, 0), (2, 1)}


def test_index_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame(
        [("a", "red fox runs", "yes"), ("b", "red fox sleeps", "no"), ("c", "blue owl", "so")],
        "conversation_id string, initial_query string, first_support_reply string",
    )
    folder = str(tmp_path / "index")
    queries = spark.createDataFrame([(1, "red fox"), (2, None)], "msg_id long, message string")
    built = index_store.ensure_index(corpus, folder, stop_words=STOP)
    first = sorted(map(tuple, similarity.retrieve(queries, built).collect()))
    loaded = index_store.ensure_index(corpus.limit(0), folder)
    assert sorted(map(tuple, similarity.retrieve(queries, loaded).collect())) == first
    assert loaded.stop_words == STOP
    rebuilt = index_store.ensure_index(corpus.limit(1), folder, force=True, stop_words=STOP)
    assert rebuilt.records.count() == 1


def test_messages_without_evidence_survive(spark):
    corpus = spark.createDataFrame(
        [("a", "red fox", "yes")],
        "conversation_id string, initial_query string, first_support_reply string",
    )
    index = tfidf.build_index(corpus, stop_words=STOP)
    messages = spark.createDataFrame(
        [(1, "red fox"), (2, "green"), (3, None), (4, "red fox")], "msg_id long, message string"
    )
    rows = {r.msg_id: r for r in similarity.attach_evidence(messages, index).collect()}
    assert {i: (len(r.evidence), r.best_similarity) for i, r in rows.items()} == {
        1: (1, 1.0), 2: (0, 0.0), 3: (0, 0.0), 4: (1, 1.0),
    }


def test_evidence_corpus(spark):
    rows = [
        ("a", "q", "r", True), ("b", "", "r", True), ("c", "q", None, False),
        ("d", None, "r", True),
    ]
    schema = (
        "conversation_id string, initial_query string, first_support_reply string, "
        "has_support_reply boolean"
    )
    kept = tfidf.evidence_corpus(spark.createDataFrame(rows, schema)).collect()
    assert [r.conversation_id for r in kept] == ["a"]


def test_cases_get_their_columns_without_a_shuffle_of_texts(spark, monkeypatch):
    """Ids that repeat, are unknown or null, rows without cases, and many small blocks and tasks."""
    monkeypatch.setattr(similarity, "BYTES_PER_BLOCK", 300)
    monkeypatch.setattr(similarity, "RECORDS_PER_TASK", 200)
    records = [(f"c{i}", f"fox number{i}", f"yes {i}") for i in range(40)]
    records += [("c3", "fox number3", "twice"), (None, "fox nobody", "none")]
    corpus = spark.createDataFrame(
        records, "conversation_id string, initial_query string, first_support_reply string"
    )
    index = tfidf.build_index(corpus, stop_words=STOP)
    ids = [[f"c{(7 * i + j) % 40}" for j in range(i % 4)] for i in range(600)]
    ids += [[], ["c3", "unknown"], [None, "c3"], ["unknown"]]
    rows = [(i, f"m{i}", [(j + 1, x, 0.5) for j, x in enumerate(xs)]) for i, xs in enumerate(ids)]
    kind = "array<struct<rank: int, record_id: string, similarity_score: double>>"
    stored = spark.createDataFrame(rows, f"msg_id long, message string, evidence {kind}")
    want = {
        i: sorted((rank, x, s, r[2]) for rank, x, s in cases for r in records if x and r[0] == x)
        for i, _, cases in rows
    }
    filled = similarity.with_cases(stored, index, ("first_support_reply",))
    found = filled.collect()
    assert len(found) == len(rows) and filled.columns == stored.columns
    assert {r.msg_id: list(map(tuple, r.evidence)) for r in found} == want
    again = similarity.case_ids(filled).where("msg_id = 7").first()
    assert list(map(tuple, again.evidence)) == rows[7][2]
    nothing = similarity.with_cases(stored.where("size(evidence) = 0"), index)
    assert all(r.evidence == [] for r in nothing.collect()) and nothing.count() == 151


@pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are absent")
def test_triaged_messages_are_stored_without_the_texts_of_their_cases(spark):
    from threadwise.registry import inputs

    stored = inputs.triaged(spark, str(TESTDATA))
    assert stored.schema["evidence"].dataType.elementType.names == list(similarity.CASE)


def test_retrieval_leaves_only_what_is_read_later(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame(
        [(i, t, f"answer {i}") for i, t in random_texts(5, 40, 60, 8)],
        "conversation_id long, initial_query string, first_support_reply string",
    )
    index = tfidf.build_index(corpus, stop_words=STOP)
    messages = spark.createDataFrame(
        [*random_texts(6, 30, 60, 8, 0.2), (77, None)], "msg_id long, message string"
    )
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    before = {r.msg_id: r for r in similarity.attach_evidence(messages, index).collect()}
    # The messages with the ids of their cases, and the records of those.
    assert len(list(tmp_path.iterdir())) == 2
    assert len(before) == 31 and sum(len(r.evidence) for r in before.values()) > 30


def test_rows_of_queries_are_shuffled_once_for_their_plan(spark):
    texts = spark.createDataFrame(random_texts(7, 60, 60, 8), "conversation_id long, initial_query string")
    index = tfidf.build_index(texts, stop_words=STOP)
    rows = texts.selectExpr("conversation_id AS q", "initial_query AS text")
    vectors = cut_lineage(tfidf.transform(tfidf.together(rows, "q"), "q", "text", index))
    plan = similarity._query_plan(vectors, index, 3, 0.01)
    plan.collect()
    executed = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in executed


def test_terms_of_queries_are_not_shuffled(spark):
    texts = spark.createDataFrame(random_texts(8, 60, 60, 8), "conversation_id long, initial_query string")
    index = tfidf.build_index(texts, stop_words=STOP)
    rows = tfidf.together(texts.selectExpr("conversation_id AS q", "initial_query AS text"), "q")
    plan = tfidf.transform(rows, "q", "text", index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
