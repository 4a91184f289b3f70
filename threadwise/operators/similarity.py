"""Exact top-k cosine similarity between two tables of sparse vectors.

Weights are non-negative and vectors have unit length, so the score of a pair is the sum of
products over shared terms, and a term adds at most ``query weight x largest document weight``.

1. *First guess.* Among the documents in which a query's terms weigh most, k of each term at least,
   the k-th best sum over those terms is a score the final list must reach.
2. *Skip common terms.* Starting from the term that spares the most postings for what it can add
   to a score, terms are set aside while all of them together could not reach that score. A
   document that shares only those cannot be in the list, so they ask for no documents.
3. *Blocks.* The vectors of the documents asked for and the queries are packed into blocks, one row
   of a written table each. Every pair of blocks is one row of a Cartesian product, whose tasks read
   the written blocks as they need them, so that no vector is shuffled or written once per block of
   the other side. A task adds up the products of a query over the block's postings, exact scores
   at once, and keeps the k best per query that reach the floor, over all blocks it meets.
4. *Merge.* The lists of all tasks meet in one ranking per query.

The products of a pair of rows never leave the task that makes them: what is shuffled are the
vectors, once, and at most k rows per query and task that meets it.

Cases are ids until the end. Their texts, several times the input when every message has its own
copy, are read by the tasks that hold the messages, and neither shuffled nor written (``with_cases``).

What a set of terms can add is bounded twice, and the smaller bound counts: by the sum of what each
can add, and, since no vector is longer than one, by the length of the query's part on the set.

Nothing is sampled or capped: every step removes only pairs that provably miss the list.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from threadwise.operators.tfidf import (
    TfidfIndex,
    bounded_broadcast,
    distinct_texts,
    term_bucket,
    text_key,
    together,
    transform,
)
from threadwise.rules import fixed_values as fixed
from threadwise.session import cut_lineage, settle, task_count

# Scores are compared after rounding to this many places, which hides summation order.
SCORE_PLACES = 10
# Slack for bounds, far above rounding error and far below SCORE_PLACES.
SLACK = 1e-9
# A block of documents has about so many postings, a block of queries so many terms.
POSTINGS_PER_KEY = 2_000_000
TERMS_PER_KEY = 2_000_000
# Smaller tables are dealt to as many tasks, but to no smaller blocks of queries.
LEAST_TASKS, LEAST_TERMS = 24, 100_000
# Terms of queries that a task compares with the champions of their terms.
TERMS_PER_TASK = 100_000
# The least number of documents that first guesses take per term.
LEAST_CHAMPIONS = 16
# What is stored of a case; the other columns are those of its record.
CASE = ("rank", "record_id", "similarity_score")
# Bytes of a block of records or messages, and of the records that a task keeps for its messages.
BYTES_PER_BLOCK = 16_000_000
RECORDS_PER_TASK = 128_000_000
# Messages that leave a task at once, with their cases.
MESSAGES_PER_BATCH = 256


def _best(score: str, tie: str, k: int) -> Column:
    return F.row_number().over(Window.partitionBy("q").orderBy(F.desc(score), tie))


def _floors(
    query: DataFrame, terms: DataFrame, index: TfidfIndex, k: int, min_score: float
) -> DataFrame:
    """(q, floor): the k-th best sum among first guesses, where there are k of them.

    A document's whole score is no less than its sum over some terms. ``query`` lies together by q,
    so neither the sums nor their ranking are shuffled; ``terms`` holds all its term ids.
    """
    size = max(LEAST_CHAMPIONS, k)
    lists = index.champion_lists(terms, size)
    return (
        query.join(bounded_broadcast(lists, index.max_features * size), "term_id")
        .groupBy("q", "doc")
        .agg(F.sum(F.col("w") * F.col("dw")).alias("bound"))
        .withColumn("rank", _best("bound", "doc", k))
        .where(F.col("rank") == k)
        .select("q", F.greatest("bound", F.lit(min_score)).alias("floor"))
    )


def _query_plan(query: DataFrame, index: TfidfIndex, k: int, min_score: float) -> DataFrame:
    """(q, floor, terms, weights, asked): a query's vector, and the terms that ask for documents."""
    # No block holds a query without an id. Said once here, so that both readers of the rows below
    # share one shuffle.
    terms = query.where("q IS NOT NULL AND term_id IS NOT NULL AND w IS NOT NULL")
    query = terms.repartition(task_count(terms, terms.count(), TERMS_PER_TASK), "q")
    impacts = bounded_broadcast(index.impacts, index.max_features)
    per_query = Window.partitionBy("q")
    common_first = per_query.orderBy(F.desc(F.col("docs") / F.col("gain")), "term_id")
    square = F.col("w") * F.col("w")
    entry = F.struct("term_id", "w", "aside")
    return (
        query.join(impacts, "term_id")
        .join(_floors(query, terms, index, k, min_score), "q", "left")
        .withColumn("floor", F.coalesce("floor", F.lit(min_score)) - SLACK)
        .withColumn("gain", F.col("w") * F.col("max_w"))
        .withColumn(
            "reach",
            F.least(F.sum("gain").over(common_first), F.sqrt(F.sum(square).over(common_first))),
        )
        .withColumn("aside", F.col("reach") < F.col("floor"))
        .groupBy("q")
        .agg(F.max("floor").alias("floor"), F.sort_array(F.collect_list(entry)).alias("entries"))
        .select(
            "q",
            "floor",
            F.col("entries.term_id").alias("terms"),
            F.col("entries.w").alias("weights"),
            F.filter("entries", lambda e: ~e["aside"])["term_id"].alias("asked"),
        )
    )


def best_vectors(
    query: DataFrame, index: TfidfIndex, k: int, min_score: float
) -> DataFrame:
    """(q, doc, score): the k best vectors per query; ``query`` is (q, term_id, w)."""
    spark = query.sparkSession
    plan = settle(spark, lambda: _query_plan(cut_lineage(query), index, k, min_score))
    scored = candidate_pairs(plan, index, k).where(F.col("score") >= min_score)
    return scored.withColumn("rank", _best("score", "doc", k)).where(F.col("rank") <= k).drop("rank")


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column, and where each row's begin, the end of the last included."""
    column = table.column(name).combine_chunks()
    sizes = np.asarray(pc.list_value_length(column))
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(sizes)])


def packed_queries(queries: pa.Table) -> dict[str, np.ndarray]:
    """A block of queries as arrays: terms and weights one after the other, and a floor each."""
    terms, begins = _lists(queries, "terms")
    return {
        "begins": begins.astype(np.int64),
        "asked": terms.astype(np.int32),
        "asked_weights": _lists(queries, "weights")[0].astype(np.float64),
        "floors": queries.column("floor").to_numpy().astype(np.float64),
    }


def packed_documents(documents: pa.Table) -> dict[str, np.ndarray]:
    """A block of documents as postings: the terms held, where each one's begin, rows and weights."""
    terms, begins = _lists(documents, "terms")
    rows = np.repeat(np.arange(documents.num_rows, dtype=np.int32), np.diff(begins))
    by_term = np.argsort(terms, kind="stable")
    held, starts = np.unique(terms[by_term], return_index=True)
    return {
        "held": held.astype(np.int32),
        "starts": np.append(starts, len(terms)).astype(np.int64),
        "rows": rows[by_term],
        "weights": _lists(documents, "weights")[0][by_term].astype(np.float64),
    }


QUERY_ARRAYS = {"begins": "i8", "asked": "i4", "asked_weights": "f8", "floors": "f8"}
DOCUMENT_ARRAYS = {"held": "i4", "starts": "i8", "rows": "i4", "weights": "f8"}


def block_scores(
    queries: dict[str, np.ndarray], documents: dict[str, np.ndarray], count: int, k: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, document rows, scores) of a pair of packed blocks, per query the k best.

    The ``count`` documents stand in the order of their ids, which decides among equal scores.
    """
    held, starts = documents["held"], documents["starts"]
    rows, weights = documents["rows"], documents["weights"]
    begins, asked, asked_weights = (queries[n] for n in ("begins", "asked", "asked_weights"))
    places = np.searchsorted(held, asked)
    known = held[np.minimum(places, len(held) - 1)] == asked if len(held) else asked < 0
    floors = np.maximum(queries["floors"], np.finfo(float).tiny)
    found_queries = [np.empty(0, dtype=np.int64)]
    found_rows = [np.empty(0, dtype=np.int64)]
    found_scores = [np.empty(0)]
    totals = np.zeros(count)
    for q in range(len(begins) - 1):
        for i in range(begins[q], begins[q + 1]):
            if known[i]:
                part = slice(starts[places[i]], starts[places[i] + 1])
                totals[rows[part]] += asked_weights[i] * weights[part]
        found = np.flatnonzero(totals >= floors[q])
        if len(found):
            scores = np.round(totals[found], SCORE_PLACES)
            best = np.lexsort((found, -scores))[:k]
            found_queries.append(np.full(len(best), q))
            found_rows.append(found[best])
            found_scores.append(scores[best])
        totals.fill(0.0)
    return tuple(map(np.concatenate, (found_queries, found_rows, found_scores)))


def _k_best(found: pa.Table, k: int) -> pa.Table:
    """The k best rows per query of (place, doc, score), in order."""
    order = [("place", "ascending"), ("score", "descending"), ("doc", "ascending")]
    found = found.sort_by(order).combine_chunks()
    places = found.column("place").to_numpy()
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    sizes = np.diff(np.append(starts, len(places)))
    return found.filter(pa.array(np.arange(len(places)) - np.repeat(starts, sizes) < k))


def _documents_asked(plan: DataFrame, index: TfidfIndex) -> DataFrame:
    """(doc, terms, weights) of documents that hold a term asked.

    The terms asked are few and broadcast, so a stored index reads only the buckets that hold them.
    """
    asked = plan.select(F.explode("asked").alias("term_id")).distinct()
    keys = bounded_broadcast(
        asked.withColumn("bucket", term_bucket(F.col("term_id"))), index.max_features
    )
    holding = index.postings.join(keys, ["bucket", "term_id"]).select("doc").distinct()
    return index.vectors.join(holding, "doc", "left_semi")


def _blocks(
    df: DataFrame, key: str, keys: int, size: int, side: str, pack, arrays: dict
) -> DataFrame:
    """(<side>_block, <side>_ids, <an array each>): blocks of about ``size`` terms; ids ascend.

    Any rows may share a block, so blocks are packed where the rows lie, in about ``keys`` tasks.
    """
    kind = df.schema[key].dataType.simpleString()
    columns = [f"{side}_block long", f"{side}_ids array<{kind}>", *(f"{n} binary" for n in arrays)]

    def packed(parts: list, number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        rows = rows.take(pc.sort_indices(rows.column(key)))
        ids = rows.column(key).combine_chunks()
        block = (TaskContext.get().partitionId() << 32) + number
        found = {
            f"{side}_block": pa.array([block], pa.int64()),
            f"{side}_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        }
        values = pack(rows)
        return pa.RecordBatch.from_pydict(
            found | {n: pa.array([values[n].tobytes()], pa.binary()) for n in arrays}
        )

    def pack_all(batches):
        parts, held, number = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                held += pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
            if held >= size:
                yield packed(parts, number)
                parts, held, number = [], 0, number + 1
        if parts:
            yield packed(parts, number)

    rows = df.where(F.col(key).isNotNull()).coalesce(keys)
    return rows.mapInArrow(pack_all, ", ".join(columns))


def candidate_pairs(plan: DataFrame, index: TfidfIndex, k: int | None = None) -> DataFrame:
    """(q, doc, score): pairs that may be in a list, at most k per query and task that meets it."""
    postings = index.impacts.agg(F.sum("docs")).first()[0] or 0
    terms = plan.agg(F.sum(F.size("terms"))).first()[0] or 0
    doc_keys = max(1, ceil(postings / POSTINGS_PER_KEY))
    query_keys = max(
        1, ceil(terms / TERMS_PER_KEY), min(LEAST_TASKS, ceil(terms / LEAST_TERMS))
    )
    queries = _blocks(
        plan.drop("asked"), "q", query_keys, ceil(terms / query_keys) or 1, "q",
        packed_queries, QUERY_ARRAYS,
    )
    documents = _blocks(
        _documents_asked(plan, index), "doc", doc_keys, POSTINGS_PER_KEY, "d",
        packed_documents, DOCUMENT_ARRAYS,
    )
    # Blocks are written where they are read more than once.
    if query_keys > 1:
        queries, documents = cut_lineage(queries), cut_lineage(documents)
    kinds = [plan.schema["q"].dataType, index.vectors.schema["doc"].dataType]
    schema = f"q {kinds[0].simpleString()}, doc {kinds[1].simpleString()}, score double"

    def score(batches):
        best, ids = {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                block, held = row["q_block"].as_py(), row["d_ids"].values
                asking, docs = (
                    {n: np.frombuffer(row[n].as_buffer(), dtype) for n, dtype in arrays.items()}
                    for arrays in (QUERY_ARRAYS, DOCUMENT_ARRAYS)
                )
                by_query, by_row, scores = block_scores(asking, docs, len(held), k)
                found = pa.table(
                    {"place": by_query, "doc": held.take(pa.array(by_row)), "score": scores}
                )
                if k is None:
                    found = found.append_column("q", row["q_ids"].values.take(found.column("place")))
                    yield from found.select(["q", "doc", "score"]).to_batches()
                else:
                    ids.setdefault(block, pa.concat_arrays([row["q_ids"].values]))
                    earlier = [best[block]] if block in best else []
                    best[block] = _k_best(pa.concat_tables([*earlier, found]), k)
        for block, found in best.items():
            found = found.append_column("q", ids[block].take(found.column("place")))
            yield from found.select(["q", "doc", "score"]).to_batches()

    # Partitions of the product that follow each other share their queries, so a task of several
    # keeps one list per query. The hint keeps blocks from being sent through the driver.
    pairs = queries.hint("shuffle_replicate_nl").crossJoin(documents)
    tasks = query_keys * ceil(LEAST_TASKS / query_keys)
    found = pairs.coalesce(tasks).mapInArrow(score, schema)
    return found.withColumn("score", F.round("score", SCORE_PLACES))


def _record_columns(index: TfidfIndex) -> list[str]:
    return [c for c in index.records.columns if c not in ("doc", "record_id")]


def retrieve_texts(
    texts: DataFrame,
    index: TfidfIndex,
    k: int = fixed.AGENT_TOP_K,
    min_score: float = fixed.MIN_SIMILARITY,
    columns: list[str] | None = None,
) -> DataFrame:
    """(q, rank, record_id, similarity, similarity_score, <columns>) for (q, text) rows.

    Equal scores rank by record id. Texts without a match have no rows. ``similarity`` is the
    score at full precision; ``similarity_score`` is rounded to four places.
    """
    if columns is None:
        columns = _record_columns(index)
    # Texts are dealt by query, so that their terms, many times as many rows, need not move.
    dealt = together(texts.where(F.col("q").isNotNull()), "q")
    vectors = settle(
        texts.sparkSession,
        lambda: best_vectors(transform(dealt, "q", "text", index), index, k, min_score),
    )
    # Only the k smallest ids among copies of a record can appear in a list of k, and only records
    # of vectors found are sorted.
    member = F.row_number().over(Window.partitionBy("doc").orderBy("record_id"))
    members = (
        index.records.select("doc", "record_id")
        .join(vectors.select("doc").distinct(), "doc", "left_semi")
        .withColumn("member", member)
        .where(F.col("member") <= k)
        .drop("member")
    )
    order = Window.partitionBy("q").orderBy(F.desc("score"), "record_id")
    best = (
        vectors.join(members, "doc")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            "q",
            "rank",
            "record_id",
            F.col("score").alias("similarity"),
            F.round("score", 4).alias("similarity_score"),
        )
    )
    # The wide columns join last, for the final list only.
    return best.join(index.records.select("record_id", *columns), "record_id") if columns else best


def _query_texts(messages: DataFrame, key: str, text: str) -> DataFrame:
    """(q, text): copies of a message are answered once, under the smallest key."""
    texts = distinct_texts(messages.where(F.col(text).isNotNull()), key, text)
    return cut_lineage(texts.select(F.col(key).alias("q"), "text"))


def _by_text_key(texts: DataFrame) -> DataFrame:
    """(text_key, q): a digest stands for the text wherever copies have to meet."""
    return texts.select(text_key(F.col("text")).alias("text_key"), "q")


def retrieve(
    messages: DataFrame,
    index: TfidfIndex,
    key: str = "msg_id",
    text: str = "message",
    k: int = fixed.AGENT_TOP_K,
    min_score: float = fixed.MIN_SIMILARITY,
    columns: list[str] | None = None,
) -> DataFrame:
    """The rows of ``retrieve_texts`` for every message, keyed by ``key``."""
    if columns is None:
        columns = _record_columns(index)
    texts = _query_texts(messages, key, text)
    best = retrieve_texts(texts, index, k, min_score, columns=[])
    same_text = messages.select(key, text_key(F.col(text)).alias("text_key")).join(
        _by_text_key(texts), "text_key"
    )
    found = same_text.select(key, "q").join(best, "q").drop("q")
    if not columns:
        return found
    # The wide columns join last, so that they move once per record, not once per message.
    return found.join(index.records.select("record_id", *columns), "record_id").select(
        key, "record_id", "rank", "similarity", "similarity_score", *columns
    )


def cosine_pairs(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str
) -> DataFrame:
    """(left_key, right_key, similarity) of given pairs; vectors are (key, term_id, w)."""
    shared = (
        pairs.join(left.withColumnRenamed("w", "lw"), left_key)
        .join(right.withColumnRenamed("w", "rw"), [right_key, "term_id"])
        .groupBy(left_key, right_key)
        .agg(F.sum(F.col("lw") * F.col("rw")).alias("similarity"))
    )
    return pairs.join(shared, [left_key, right_key], "left").withColumn(
        "similarity", F.coalesce("similarity", F.lit(0.0))
    )


def nest_evidence(evidence: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, evidence, best_similarity): at most k structs per key, in rank order."""
    case = F.struct(*CASE, *columns)
    return evidence.groupBy(key).agg(
        F.sort_array(F.collect_list(case)).alias("evidence"),
        F.max("similarity_score").alias("best_similarity"),
    )


def case_ids(rows: DataFrame) -> DataFrame:
    """Rows with the ids and scores of their cases alone; ``with_cases`` adds the columns again."""
    bare = F.transform("evidence", lambda case: F.struct(*[case[n].alias(n) for n in CASE]))
    return rows.withColumn("evidence", bare)


def _streams(rows: DataFrame) -> DataFrame:
    """(block, bytes, number): rows packed where they lie, each block an Arrow stream."""

    def block(parts: list) -> pa.RecordBatch:
        rows, sink = pa.Table.from_batches(parts), pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
            stream.write_table(rows)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                "bytes": pa.array([rows.nbytes], pa.int64()),
                "number": pa.array([rows.num_rows], pa.int64()),
            }
        )

    def pack(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                held += batch.nbytes
            if held >= BYTES_PER_BLOCK:
                yield block(parts)
                parts, held = [], 0
        if parts:
            yield block(parts)

    return rows.mapInArrow(pack, "block binary, bytes long, number long")


class Gatherer:
    """A block of messages that meets all blocks of records and keeps those of its cases."""

    def __init__(self, messages: pa.Table, columns: list[str], kinds: pa.Schema):
        self.messages, self.columns, self.kinds = messages.combine_chunks(), columns, kinds
        cases = self.messages.column("evidence").combine_chunks()
        sizes = np.asarray(pc.fill_null(pc.list_value_length(cases), 0))
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.cases = cases.flatten()
        ids = pc.struct_field(self.cases, "record_id")
        self.asked = pc.drop_null(pc.unique(ids))
        self.codes = np.asarray(pc.fill_null(pc.index_in(ids, self.asked), -1))
        self.found = []

    def meet(self, records: pa.Table) -> None:
        code = pc.index_in(records.column("record_id"), self.asked)
        kept = records.select(self.columns).append_column("", code).filter(pc.is_valid(code))
        if kept.num_rows:
            self.found.append(kept)

    def filled(self):
        """The messages with the columns of their cases.

        A case stands once for each record of its id, so not at all where there is none.
        """
        if self.found:
            records = pa.concat_tables(self.found)
            code = records.column("").to_numpy()
        else:
            records, code = self.kinds.empty_table(), np.empty(0, dtype=np.int32)
        by_code = np.argsort(code, kind="stable")
        firsts = np.searchsorted(code[by_code], self.codes, "left")
        counts = np.searchsorted(code[by_code], self.codes, "right") - firsts
        for start in range(0, self.messages.num_rows, MESSAGES_PER_BATCH):
            rows = self.messages.slice(start, MESSAGES_PER_BATCH)
            begins = self.begins[start : start + rows.num_rows + 1]
            here = slice(begins[0], begins[-1])
            ends = np.concatenate([[0], np.cumsum(counts[here])])
            places = np.arange(ends[-1]) + np.repeat(firsts[here] - ends[:-1], counts[here])
            case = self.cases.take(pa.array(np.repeat(np.arange(here.start, here.stop), counts[here])))
            record = records.take(pa.array(by_code[places]))
            fields = {name: pc.struct_field(case, name) for name in CASE}
            fields |= {name: record.column(name).combine_chunks() for name in self.columns}
            evidence = pa.ListArray.from_arrays(
                pa.array(ends[begins - begins[0]], pa.int32()),
                pa.StructArray.from_arrays(list(fields.values()), list(fields)),
            )
            place = rows.schema.get_field_index("evidence")
            yield from rows.set_column(place, "evidence", evidence).combine_chunks().to_batches()


def with_cases(
    rows: DataFrame,
    index: TfidfIndex,
    columns: tuple[str, ...] = ("initial_query", "first_support_reply"),
) -> DataFrame:
    """Rows whose ``evidence`` holds cases by their ids, with the named columns of the records.

    The records asked for are written once, in blocks. Every task holds a share of the rows and
    reads all blocks, so a record is neither shuffled nor written once per row that it is a case of,
    and a task keeps about RECORDS_PER_TASK bytes at most. ``rows`` is read several times, so hand
    over a table and not a long computation.
    """
    columns = list(columns)
    asked = rows.select(F.explode("evidence.record_id").alias("record_id")).distinct()
    records = index.records.select("record_id", *columns).join(asked, "record_id", "left_semi")
    # An empty block besides, so that rows meet one even where no record is asked for.
    none = rows.sparkSession.range(1).selectExpr("cast(null AS binary)", "0L", "0L")
    blocks = cut_lineage(_streams(records).union(none))
    width, cases = (
        table.agg(F.coalesce(value, F.lit(0))).first()[0]
        for table, value in (
            (blocks, F.sum("bytes") / F.greatest(F.sum("number"), F.lit(1))),
            (rows, F.sum(F.size("evidence"))),
        )
    )
    dealt = rows.repartition(task_count(rows, ceil(cases * width), RECORDS_PER_TASK))
    messages = _streams(dealt).select(
        F.monotonically_increasing_id().alias("place"), F.col("block").alias("messages")
    )
    case = [*rows.schema["evidence"].dataType.elementType, *index.records.select(*columns).schema]
    filled = T.StructField("evidence", T.ArrayType(T.StructType(case)))
    schema = T.StructType([filled if f.name == "evidence" else f for f in rows.schema])
    kinds = to_arrow_schema(index.records.select(*columns).schema)

    def table(block) -> pa.Table:
        return pa.ipc.open_stream(block.as_buffer()).read_all()

    def gather(batches):
        gatherers = {}
        for batch in batches:
            for place, messages, block in zip(*batch.select(["place", "messages", "block"])):
                place = place.as_py()
                if place not in gatherers:
                    gatherers[place] = Gatherer(table(messages), columns, kinds)
                if block.is_valid:
                    gatherers[place].meet(table(block))
        for gatherer in gatherers.values():
            yield from gatherer.filled()

    # All blocks are one partition, which streams past the messages that a task holds.
    pairs = blocks.select("block").coalesce(1).hint("shuffle_replicate_nl").crossJoin(messages)
    return pairs.mapInArrow(gather, schema).withColumn("evidence", F.sort_array("evidence"))


def attach_evidence(
    messages: DataFrame,
    index: TfidfIndex,
    key: str = "msg_id",
    text: str = "message",
    k: int = fixed.AGENT_TOP_K,
    min_score: float = fixed.MIN_SIMILARITY,
    columns: tuple[str, ...] = ("initial_query", "first_support_reply"),
) -> DataFrame:
    """Messages with ``evidence`` and ``best_similarity``; none found gives [] and 0.0."""

    def with_ids() -> DataFrame:
        texts = _query_texts(messages, key, text)
        best = retrieve_texts(texts, index, k, min_score, columns=[])
        if columns:
            best = best.where(F.col("record_id").isNotNull())
        nested = nest_evidence(best, "q", [])
        kind = nested.schema["evidence"].dataType.simpleString()
        # The cases are gathered by query and stay there: what moves to them are the messages.
        # Messages without a text share no key that could gather them in one task.
        found = (
            messages.where(F.col(text).isNotNull())
            .withColumn("text_key", text_key(F.col(text)))
            .join(_by_text_key(texts), "text_key")
            .join(nested, "q", "left")
            .drop("text_key", "q")
        )
        return (
            found.unionByName(messages.where(F.col(text).isNull()), allowMissingColumns=True)
            .withColumn("evidence", F.coalesce("evidence", F.expr(f"cast(array() as {kind})")))
            .withColumn("best_similarity", F.coalesce("best_similarity", F.lit(0.0)))
        )

    if not columns:
        return with_ids()
    return with_cases(settle(messages.sparkSession, with_ids), index, columns)
