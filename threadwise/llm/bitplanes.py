"""Token ids in files of compressed planes.

Documents are sorted by id and encoded, each followed by an end id. A task's ids are cut into blocks
of fixed size. A block's 32-bit ids are transposed into byte planes (or bit planes), so that the
high bytes, which hardly vary, lie together, and every plane is compressed with zstandard. A row of
the files is one block: its shard (the range of documents it is from), its number there, how many
ids it holds, its planes, and which parts of which documents lie in it. Beside the blocks lies an
index of the shards with the position of their first id, so a block can be found by position alone:
all blocks of a shard but the last are full.

Files are Parquet, written and read by Spark: a lost task writes its shard again, and any store that
Spark reaches will do. Blocks are decoded independently; documents that cross blocks are put
together by number, and their checksums are combined without their ids.

Defined results: null text is the empty text, a document of the end id alone; documents with a null
id come first; documents of equal id are ordered by a hash of their text; an empty table gives an
empty file and index. Other columns are not stored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadwise.llm.common import kept_by_worker, whole_text

BLOCK_IDS = 65_536
LEVEL = 1
# Chunks of text, and words, that one Python worker remembers: so many new ones, and as many of the
# time before that.
REMEMBERED = 400_000

SEGMENT = "struct<row: long, doc_id: long, part: int, start: int, length: int>"
BLOCK = (
    "shard int, block long, n_ids int, plane_bits int, planes array<binary>, "
    f"segments array<{SEGMENT}>"
)


# --- blocks ------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, plane_bits: int = 8) -> list[bytes]:
    """Compressed planes of little-endian 32-bit ids, the lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        planes = octets.T
    elif plane_bits == 1:
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)
    else:
        raise ValueError("planes are bits (1) or bytes (8)")
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    return [compress(np.ascontiguousarray(plane).tobytes()) for plane in planes]


def from_planes(planes: list[bytes], n_ids: int, plane_bits: int = 8) -> np.ndarray:
    decompress = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(decompress(plane), dtype=np.uint8) for plane in planes])
    if plane_bits == 1:
        bits = np.unpackbits(rows, axis=1)[:, :n_ids].T
        octets = np.packbits(bits, axis=1, bitorder="little")
    else:
        octets = rows.T
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


# --- encoding ----------------------------------------------------------------------------------


def _shown_bytes() -> dict[int, str]:
    """How byte-level tokenizers write bytes: visible ones as themselves, others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(0x100) if byte not in visible]
    return {byte: chr(0x100 + place) for place, byte in enumerate(hidden)}


SHOWN = _shown_bytes()
# A word of Latin letters and what punctuation follows: two pre-tokens, whatever comes next. A single
# line break between two such words is a pre-token, too. Apostrophes are left out, since the
# pattern knows contractions.
_LETTERS = r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]"
SIGNS = string.punctuation.replace("'", "")
LATIN = re.compile(f"{_LETTERS}+")
_WORD = rf"({_LETTERS}*)([{re.escape(SIGNS)}]*)"
PLAIN = re.compile(rf"{_WORD}(?:\n(?=\S){_WORD})?")


class Remembered(dict):
    """Values by key, computed when a key is first asked for; a bounded number is kept.

    A full generation becomes the older one. What is asked for again comes back from there, so
    frequent keys stay and only rare ones are forgotten.
    """

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts as bytes, by chunks cut where the tokenizer always cuts.

    Its pattern starts a new pre-token at every space that a visible character follows, so the text
    from one such space to the next is encoded on its own, and remembered. Most chunks are a word
    and punctuation, whose pre-tokens go straight to the tokenizer's model.
    """

    def __init__(self, tokenizer: Tokenizer):
        if tokenizer.normalizer is not None:
            raise ValueError("a tokenizer without normalizer is needed")
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        top = max(tokenizer.get_vocab().values(), default=0)
        self.octets = [number.to_bytes(4, "little") for number in range(top + 1)]
        self.special = [
            token.content for token in tokenizer.get_added_tokens_decoder().values()
        ]
        self.chunks = Remembered(self._encode_rest)
        self.words = Remembered(self._encode_word)
        self.cut = re.compile(r" (?=\S)")
        self.uncut = re.compile(r" (?:\s|$)")

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; special strings in a text are their special ids."""
        first, *rest = (self.cut.split if self.uncut.search(text) else _at_spaces)(text)
        return self._encode_chunk(first) + b"".join(map(self.chunks.__getitem__, rest))

    def _encode_rest(self, chunk: str) -> bytes:
        """A chunk with the space before it."""
        if chunk.isascii() and chunk.isalpha():
            return self.words[" " + chunk]
        letters = chunk.rstrip(SIGNS)
        if LATIN.fullmatch(letters):
            signs = chunk[len(letters) :]
            return self.words[" " + letters] + (self.words[signs] if signs else b"")
        plain = PLAIN.fullmatch(chunk)
        if not plain or not (plain[1] or plain[2]):
            return self._encode_chunk(" " + chunk)
        letters, signs, next_letters, next_signs = plain.groups()
        found = [" " + letters, signs] if letters else [" " + signs]
        if next_letters or next_signs:
            found += ["\n", next_letters, next_signs]
        return b"".join([self.words[word] for word in found if word])

    def _encode_word(self, word: str) -> bytes:
        """One pre-token, by the model alone."""
        if word.isascii() and word != "\n":
            shown = word.replace(" ", SHOWN[0x20])
        else:
            shown = word.encode().decode("latin-1").translate(SHOWN)
        return b"".join([self.octets[token.id] for token in self.model.tokenize(shown)])

    def _encode_chunk(self, chunk: str) -> bytes:
        """Any chunk, by the whole tokenizer where it holds a special string."""
        tokenizer = self.tokenizer
        if any(text in chunk for text in self.special):
            ids = tokenizer.encode(chunk, add_special_tokens=False).ids
        else:
            ids = [
                token.id
                for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chunk)
                for token in tokenizer.model.tokenize(word)
            ]
        return np.array(ids, dtype="<u4").tobytes()


def _at_spaces(text: str) -> list[str]:
    return text.split(" ")


def _blocks(
    encoder: Encoder, batches: Iterator[pd.DataFrame], end_id: int, block_ids: int, plane_bits: int
) -> Iterator[pd.DataFrame]:
    """The rows of one shard."""
    shard = TaskContext.get().partitionId()
    end = np.array([end_id], dtype="<u4").tobytes()
    waiting: list[bytes] = []
    segments: list[tuple] = []
    held = block = row = 0

    def full_block() -> pd.DataFrame:
        ids = np.frombuffer(b"".join(waiting), dtype="<u4")
        planes = to_planes(ids, plane_bits)
        values = [shard, block, len(ids), plane_bits, planes, segments]
        names = ["shard", "block", "n_ids", "plane_bits", "planes", "segments"]
        return pd.DataFrame({name: [value] for name, value in zip(names, values)})

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            ids = memoryview(encoder.encode(text) + end)
            number = None if pd.isna(doc_id) else int(doc_id)
            part = 0
            while len(ids):
                taken = ids[: 4 * (block_ids - held)]
                ids = ids[len(taken) :]
                segments.append((row, number, part, held, len(taken) // 4))
                waiting.append(taken)
                held += len(taken) // 4
                part += 1
                if held == block_ids:
                    yield full_block()
                    waiting, segments, held, block = [], [], 0, block + 1
            row += 1
    if held:
        yield full_block()


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
    plane_bits: int = 8,
) -> None:
    """Write ``path``/blocks and ``path``/shards in ascending order of ``doc_id``.

    The texts are shuffled once, by ranges of (id, hash of the text), so rows that share one id are
    still many ranges.
    """
    stored = Tokenizer.from_file(tokenizer_path).to_str()
    name = f"encoder_{zlib.crc32(stored.encode())}"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept_by_worker(name, lambda: Encoder(Tokenizer.from_str(stored)))
        yield from _blocks(encoder, batches, end_id, block_ids, plane_bits)

    whole = whole_text(text)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = (
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.xxhash64(whole).alias("tie"),
            whole.alias("text"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    blocks = ordered.mapInPandas(encode, BLOCK)
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    totals = (
        spark.read.schema(BLOCK)
        .parquet(f"{path}/blocks")
        .groupBy("shard")
        .agg(F.sum("n_ids").alias("n_ids"))
    )
    # One row per shard, so this window holds as many rows as there were tasks.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = totals.withColumn("first_id", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    index.write.mode("overwrite").parquet(f"{path}/shards")


# --- reading -----------------------------------------------------------------------------------


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(``shard``, ``n_ids``, ``first_id``)."""
    return spark.read.schema("shard int, n_ids long, first_id long").parquet(f"{path}/shards")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks")


def _segments(blocks: DataFrame, value: str, kind: str, of_part) -> DataFrame:
    """One row per part of a document, with a value made from the part's ids."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for found in batch.itertuples(index=False):
                ids = from_planes(list(found.planes), found.n_ids, found.plane_bits)
                parts = pd.DataFrame(list(found.segments))
                parts["shard"], parts["block"] = found.shard, found.block
                parts["doc_id"] = parts["doc_id"].astype("Int64")
                parts[value] = [
                    of_part(ids[start : start + length])
                    for start, length in zip(parts["start"], parts["length"])
                ]
                yield parts

    schema = f"shard int, block long, row long, doc_id long, part int, start int, length int, {value} {kind}"
    # A row is a block of bounded size; few at a time keep a task's memory small.
    return blocks.mapInPandas(decode, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(``doc_id``, ``ids``) of every document, put together from its parts."""
    parts = _segments(read_blocks(spark, path), "ids", "array<long>", lambda ids: ids.astype(np.int64))
    return (
        parts.groupBy("shard", "row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"),
        )
        .select("doc_id", F.flatten("parts.ids").alias("ids"))
    )


def read_digests(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``) of every document, from the files.

    A document's checksum is combined from those of its parts, so no task holds a whole document.
    """
    parts = _segments(
        read_blocks(spark, path), "crc", "long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    )
    documents = (
        parts.withColumn("at", F.col("block") * block_ids + F.col("start"))
        .groupBy("shard", "row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("at").alias("at"),
            F.sum("length").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("part", "crc", "length"))).alias("parts"),
        )
    )
    return documents.join(read_index(spark, path).drop("n_ids"), "shard").select(
        "doc_id",
        (F.col("first_id") + F.col("at")).alias("start"),
        "n_tokens",
        _combined(F.col("parts.crc"), F.col("parts.length")).alias("ids_crc32"),
    )


def _combined(crcs: Column, lengths: Column) -> Column:
    def one(parts, sizes) -> int:
        total = int(parts[0])
        for crc, size in zip(parts[1:], sizes[1:]):
            total = crc32_combine(total, int(crc), 4 * int(size))
        return total

    @F.pandas_udf("long")
    def combine(crcs: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([one(p, s) for p, s in zip(crcs, lengths)], dtype="int64")

    return combine(crcs, lengths)


CRC32_POLYNOMIAL = 0xEDB88320  # bit-reversed, the highest power in the lowest bit


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's."""
    product = 0
    for place in range(31, -1, -1):
        if a >> place & 1:
            product ^= b
        b = b >> 1 ^ CRC32_POLYNOMIAL if b & 1 else b >> 1
    return product


def crc32_combine(first: int, second: int, second_bytes: int) -> int:
    """Checksum of two byte strings joined: the first's is shifted past the second's bits."""
    shift, power = 1 << 31, 1 << 30  # one, and x
    bits = 8 * second_bytes
    while bits:
        if bits & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        bits >>= 1
    return _times(shift, first) ^ second
