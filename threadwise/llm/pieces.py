"""SentencePiece encoding and decoding over a relational lattice.

The lattice: every substring of a unit (a stretch of text that no piece can leave) up to the length
of the longest piece is joined with the piece table, and the edges found are grouped by unit. A
unit's edges are then folded into its pieces.

The models at hand are byte-pair models, whose encoding is not the path of highest total score, so
a Viterbi fold over the same lattice would not return what the library returns. The fold therefore
repeats: of the edges that cover exactly two of the current pieces take the one with the best
score, leftmost first. That is the library's result, which the tests check.

Units of all documents are counted, and the lattice is folded for the most frequent ones, a number
with a fixed bound, in Spark. Their pieces are broadcast. Units beyond that are folded inside the
task that meets them, by the same rule: joining each document with its rare units would shuffle
more than the texts themselves.

Defined results: null text is the empty text; an empty text has no ids; characters outside the
vocabulary become the pieces of their bytes, or the unknown piece where a model has none; the mark
for a space that stands in a text decodes as a space, as in the library; an empty table gives an
empty table. Input columns named like a column the operator adds are replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.llm.common import drop_columns, kept_by_worker, whole_text
from threadwise.operators.tfidf import most_frequent
from threadwise.session import cut_lineage

MARK = "▁"  # stands for a space
UNIT = rf"{MARK}*(?:[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}{MARK}]+)|{MARK}+"
# Units whose pieces are broadcast, and their longest length: places of a unit are bits of a long.
FREQUENT_UNITS = 1 << 18
LONGEST_UNIT = 62
# Chunks of text, and rare units, that one Python worker remembers.
REMEMBERED = 150_000
# Ids whose texts are put together at once.
DECODED_AT_ONCE = 1 << 19
# Texts on which a model has to agree with the library, spaces at all places among them.
PROBES = ("a  b ", " x", "\t\n", "Ａ①e\u0301", "Zoë's 日本 1999", "word\u00a0word", "")

ADDED = ("ids", "n_tokens", "decoded")


@dataclass(frozen=True)
class Model:
    """A piece table: ids and scores of pieces that merge, ids of bytes, the text of every id."""

    scores: dict[str, tuple[float, int]]
    byte_ids: tuple[int, ...]
    unknown: int
    texts: tuple[bytes, ...]
    longest: int = field(default=0)


def load(path: str) -> Model:
    """Read a model file with the library. Pieces must not reach across units."""
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, texts, bytes_ = {}, [], {}
    for number in range(library.get_piece_size()):
        piece = library.id_to_piece(number)
        if library.is_control(number) or library.is_unused(number):
            texts.append(b"")
        elif library.is_unknown(number):
            texts.append(" ⁇ ".encode())
        elif library.is_byte(number):
            bytes_[int(piece[3:5], 16)] = number
            texts.append(bytes([int(piece[3:5], 16)]))
        else:
            scores[piece] = (library.get_score(number), number)
            texts.append(piece.replace(MARK, " ").encode())
    crossing = [piece for piece in scores if not regex.fullmatch(UNIT, piece)]
    if crossing:
        raise ValueError(f"pieces reach across units: {crossing[:5]}")
    # The scores of a byte-pair model are the ranks of its merges.
    if any(score != int(score) for score, _ in scores.values()):
        raise ValueError("the scores are no ranks of merges: this is no byte-pair model")
    model = Model(
        scores,
        tuple(bytes_[value] for value in range(256)) if len(bytes_) == 256 else (),
        library.unk_id(),
        tuple(texts),
        max(map(len, scores)),
    )
    differing = [t for t in PROBES if Encoder(model, {}).encode(t).tolist() != library.encode(t)]
    if differing:
        raise ValueError(f"the model normalises or marks spaces in another way: {differing[:2]}")
    return model


def marked(text: str) -> str:
    """The text as the model sees it: spaces marked, and one in front."""
    return MARK + text.replace(" ", MARK) if text else ""


# --- the lattice in Spark ----------------------------------------------------------------------


def count_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """(``unit``, ``count``) over all whole texts."""
    whole = whole_text(text)
    spaced = F.concat(F.lit(MARK), F.translate(whole, " ", MARK))
    return (
        docs.select(
            F.explode(
                F.when(whole == "", F.array().cast("array<string>")).otherwise(
                    F.regexp_extract_all(spaced, F.lit(UNIT), F.lit(0))
                )
            ).alias("unit")
        )
        .groupBy("unit")
        .count()
    )


def frequent_units(counts: DataFrame, most: int = FREQUENT_UNITS) -> DataFrame:
    """At most ``most`` of the most frequent units, ties by unit.

    A histogram of the counts comes first, so that little more than ``most`` rows are sorted.
    """
    short = cut_lineage(counts.filter(F.length("unit") <= LONGEST_UNIT))
    return most_frequent(short, "count", "unit", most).select("unit")


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(piece, score, number) for piece, (score, number) in model.scores.items()]
    return spark.createDataFrame(rows, "piece string, score double, id int")


def _other_ids(character: Column, model: Model) -> Column:
    """Ids of a character that is no piece."""
    if not model.byte_ids:
        return F.array(F.lit(model.unknown))
    table = F.array(*map(F.lit, model.byte_ids))
    octets = F.encode(character, "UTF-8")
    return F.transform(
        F.sequence(F.lit(1), F.octet_length(octets)),
        lambda place: F.element_at(
            table, F.conv(F.hex(F.substring(octets, place, F.lit(1))), 16, 10).cast("int") + 1
        ),
    )


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """(``unit``, ``edges``): the pieces that lie in each distinct unit, best first.

    The piece table is as large as the model's vocabulary, so it is broadcast. Units stay where
    they are while they are exploded and joined, so grouping the edges by unit moves nothing.
    """
    pieces = piece_table(units.sparkSession, model)
    placed = units.repartition("unit").select(
        "unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start")
    )
    longest = F.least(F.lit(model.longest), F.length("unit") - F.col("start"))
    substrings = placed.select(
        "unit", "start", F.explode(F.sequence(F.lit(1), longest)).alias("length")
    ).withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("length")))
    end = F.col("start") + F.col("length")
    found = (
        substrings.join(F.broadcast(pieces), "piece", "left")
        .filter(F.col("id").isNotNull() | (F.col("length") == 1))
        .withColumn("piece_ids", F.when(F.col("id").isNotNull(), F.array("id")))
        .withColumn("piece_ids", F.coalesce("piece_ids", _other_ids(F.col("piece"), model)))
    )
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("start"))
    high = F.call_function("shiftleft", F.lit(1).cast("long"), end)
    edge = F.struct(
        F.coalesce(-F.col("score"), F.lit(0.0)).alias("cost"),
        F.col("start").alias("start"),
        F.col("length").alias("length"),
        (low + high).alias("ends"),
        (high - low - low).alias("inside"),
        F.col("piece_ids").alias("ids"),
    )
    return found.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def fold(edges: Column, length: Column) -> Column:
    """The ids of a unit from its edges. Its places are bits of a number; a piece lies between two.

    An edge is ready when its ends are places and one place lies inside; taking it removes that.
    """
    places = (F.call_function("shiftleft", F.lit(1).cast("long"), length + 1) - 1).cast("long")

    def ready(edge: Column, state: Column) -> Column:
        return (state.bitwiseAND(edge["ends"]) == edge["ends"]) & (
            F.bit_count(state.bitwiseAND(edge["inside"])) == 1
        )

    def merge(state: Column, _: Column) -> Column:
        best = F.get(F.filter(edges, lambda edge: ready(edge, state)), 0)
        return F.coalesce(state.bitwiseAND(F.bitwise_not(best["inside"])), state)

    def pieces(state: Column) -> Column:
        chosen = F.filter(
            edges,
            lambda edge: (state.bitwiseAND(edge["ends"]) == edge["ends"])
            & (state.bitwiseAND(edge["inside"]) == 0),
        )
        by_place = F.array_sort(
            F.transform(chosen, lambda edge: F.struct(edge["start"], edge["ids"]))
        )
        return F.flatten(F.transform(by_place, lambda edge: edge["ids"]))

    steps = F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1)))
    return F.aggregate(steps, places, merge, pieces)


def folded_units(units: DataFrame, model: Model) -> DataFrame:
    """(``unit``, ``ids``) of distinct units up to ``LONGEST_UNIT`` characters."""
    return lattice(units, model).select("unit", fold(F.col("edges"), F.length("unit")).alias("ids"))


# --- one unit, one text ------------------------------------------------------------------------


def fold_unit(unit: str, model: Model) -> list[int]:
    """The same fold for one unit of any length: a heap of edges over a linked list of pieces."""
    scores = model.scores
    parts: list[str | None] = list(unit)
    before = list(range(-1, len(parts) - 1))
    after = [*range(1, len(parts)), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(left: int) -> None:
        right = after[left]
        if left >= 0 and right >= 0:
            joined = parts[left] + parts[right]
            if joined in scores:
                heapq.heappush(heap, (-scores[joined][0], left, right, joined))

    for place in range(len(parts)):
        offer(place)
    while heap:
        _, left, right, joined = heapq.heappop(heap)
        if parts[left] is None or after[left] != right or parts[left] + parts[right] != joined:
            continue
        parts[left], parts[right] = joined, None
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    ids: list[int] = []
    for part in parts:
        if part is None:
            continue
        if part in scores:
            ids.append(scores[part][1])
        elif model.byte_ids:
            ids += [model.byte_ids[value] for value in part.encode()]
        else:
            ids.append(model.unknown)
    return ids


class Encoder:
    """Encodes texts in a task: known units are looked up, others folded, chunks remembered."""

    def __init__(self, model: Model, known: dict[str, bytes], kept: tuple[dict, dict] | None = None):
        self.model, self.known = model, known
        self.chunks, self.units = kept or ({}, {})
        self.chunk = re.compile(f"{MARK}+[^{MARK}]*")
        self.unit = regex.compile(UNIT)

    def encode(self, text: str) -> np.ndarray:
        """The ids as big-endian 32-bit numbers."""
        return np.frombuffer(self.packed(text), dtype=">i4")

    def packed(self, text: str) -> bytes:
        found = []
        for chunk in self.chunk.findall(marked(text)):
            ids = self.chunks.get(chunk)
            if ids is None:
                if len(self.chunks) >= REMEMBERED:
                    self.chunks.clear()
                ids = self.chunks[chunk] = self._chunk(chunk)
            found.append(ids)
        return b"".join(found)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(self._unit(unit) for unit in self.unit.findall(chunk))

    def _unit(self, unit: str) -> bytes:
        ids = self.known.get(unit) or self.units.get(unit)
        if ids is None:
            if len(self.units) >= REMEMBERED:
                self.units.clear()
            folded = fold_unit(unit, self.model)
            ids = self.units[unit] = struct.pack(f">{len(folded)}i", *folded)
        return ids


def decode_ids(ids, model: Model) -> str:
    """The text of ids; without the space that encoding puts in front."""
    text = b"".join([model.texts[number] for number in ids]).decode("utf-8", "replace")
    return text.removeprefix(" ")


class Decoder:
    """Puts the texts of many ids together at once: a gather from one buffer of all pieces."""

    def __init__(self, model: Model):
        self.buffer = np.frombuffer(b"".join(model.texts), dtype=np.uint8)
        self.lengths = np.array([len(text) for text in model.texts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> bytes:
        parts = []
        for at in range(0, len(ids), DECODED_AT_ONCE):  # bounded memory for very long texts
            some = ids[at : at + DECODED_AT_ONCE]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[some] - ends + lengths, lengths)
            parts.append(self.buffer[shift + np.arange(len(shift))].tobytes())
        return b"".join(parts)

    def matches(self, ids: np.ndarray, offsets: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether the ids between each two offsets decode to the text."""
        whole = self.decode(ids)
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[offsets].tolist()
        return [
            whole[start:end] == ((" " + text.replace(MARK, " ")).encode() if text else b"")
            for text, start, end in zip(texts, ends, ends[1:])
        ]


# --- operators ---------------------------------------------------------------------------------


def dictionary(docs: DataFrame, model: Model, text: str = "text") -> bytes:
    """Ids of the most frequent units, as an Arrow stream: (``unit``, ``ids``).

    At most ``FREQUENT_UNITS`` rows of bounded length; the driver hands them on as they arrive.
    """
    units = cut_lineage(frequent_units(count_units(docs, text)))
    packed = F.unhex(
        F.array_join(F.transform("ids", lambda number: F.lpad(F.hex(number), 8, "0")), "")
    )
    rows = folded_units(units, model).select("unit", packed.alias("ids")).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def looked_up(stream: bytes) -> dict[str, bytes]:
    rows = pa.ipc.open_stream(stream).read_all()
    return dict(zip(rows["unit"].to_pylist(), rows["ids"].to_pylist()))


def encoded(docs: DataFrame, path: str, text: str = "text", check: bool = False) -> DataFrame:
    """Add ``ids`` and ``n_tokens``; with ``check`` also ``decoded``: the ids decode to the text."""
    model = load(path)
    stream = dictionary(docs, model, text)
    table = zlib.crc32(stream)
    known = docs.sparkSession.sparkContext.broadcast(stream)
    del stream
    name = f"pieces_{zlib.crc32(repr((model.texts, model.scores)).encode())}"
    fields = [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
    ]
    if check:
        fields.append(T.StructField("decoded", T.BooleanType()))
    names = [field.name for field in fields]

    @F.arrow_udf(T.StructType(fields))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = kept_by_worker(name, lambda: ({}, {}))  # a unit's ids depend on the model alone
        lookups = kept_by_worker(f"{name}_units", dict)
        if table not in lookups:
            lookups.clear()  # a worker holds the units of one table of texts
            lookups[table] = looked_up(known.value)
        encoder = Encoder(model, lookups[table], kept)
        decoder = Decoder(model) if check else None
        for batch in batches:
            texts = batch.to_pylist()
            packed = [encoder.packed(text) for text in texts]
            counts = np.array([len(part) // 4 for part in packed], dtype=np.int64)
            ids = np.frombuffer(b"".join(packed), dtype=">i4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            columns = [lists, pa.array(counts)]
            if decoder:
                columns.append(pa.array(decoder.matches(ids, offsets, texts), pa.bool_()))
            yield pa.StructArray.from_arrays(columns, names)

    return (
        drop_columns(docs, *ADDED, "pieces")
        .withColumn("pieces", encode(whole_text(text)))
        .select("*", "pieces.*")
        .drop("pieces")
    )


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of the ids; null ids decode to null."""
    model = load(path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series(
                [None if found is None else decode_ids(found, model) for found in lists],
                dtype=object,
            )

    return drop_columns(docs, "decoded").withColumn("decoded", decode(F.col(ids)))
