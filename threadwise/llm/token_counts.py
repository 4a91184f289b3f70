"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is put through the model alone; those that come back as their own
single token are proven. A pre-token found among them counts one without any merging, and only the
rest is merged by the library.

No pre-token reaches across a space, so texts are cut at spaces, and the count of each chunk is
remembered by the task that met it. Chunks that hold a special string are counted by the library as
a whole.

Defined results: null text is the empty text and has no tokens; equal rows get equal counts; an
empty table gives an empty table. Input columns named like a column the operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadwise.llm.common import drop_columns, whole_text

LIMIT = 2048
# Chunks that one task remembers.
REMEMBERED = 1_000_000

ADDED = ("n_bytes", "n_tokens", "over_limit")


def load(path: str) -> Tokenizer:
    """The tokenizer, whole texts without padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def proven_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """The pre-tokens that the model encodes as one token, by trying every vocabulary string."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    special = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
    proven = set()
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if entry in special or not entry.endswith(suffix):
            continue
        word = entry[: len(entry) - len(suffix)]
        found = tokenizer.model.tokenize(word) if word else []
        if [token.id for token in found] == [number]:
            proven.add(word)
    return frozenset(proven)


class ChunkCounts(dict):
    """Tokens by chunk between spaces; a chunk is counted when it is first asked for."""

    def __init__(self, tokenizer: Tokenizer, proven: frozenset[str]):
        super().__init__()
        self.tokenizer, self.proven = tokenizer, proven
        self.special = [
            token.content for token in tokenizer.get_added_tokens_decoder().values()
        ]

    def __missing__(self, chunk: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = count = self.count(chunk)
        return count

    def count(self, chunk: str) -> int:
        tokenizer = self.tokenizer
        if any(text in chunk for text in self.special):
            return len(tokenizer.encode(chunk, add_special_tokens=False).ids)
        if tokenizer.normalizer is not None:
            chunk = tokenizer.normalizer.normalize_str(chunk)
        return sum(
            1 if word in self.proven else len(tokenizer.model.tokenize(word))
            for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chunk)
        )

    def total(self, text: str) -> int:
        return sum(map(self.__getitem__, text.split(" ")))


def check_spaces(tokenizer: Tokenizer) -> None:
    """Refuse a tokenizer whose pre-tokens may hold a space: chunks could not be counted alone."""
    for text in ("a b", "a  b", " a", "a 1 .", "a\n b"):
        normal = text
        if tokenizer.normalizer is not None:
            normal = tokenizer.normalizer.normalize_str(text)
        if any("Ġ" in word for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)):
            raise ValueError("pre-tokens of this tokenizer hold spaces")


def with_token_counts(
    docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    tokenizer = load(path)
    check_spaces(tokenizer)
    # The file's text and the proof travel with the function: executors need not have the file.
    stored, proven = tokenizer.to_str(), proven_tokens(tokenizer)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = ChunkCounts(Tokenizer.from_str(stored), proven)
        for texts in batches:
            yield pd.Series([counts.total(text) for text in texts], dtype="int64")

    whole = whole_text(text)
    return (
        drop_columns(docs, *ADDED)
        .withColumn("n_bytes", F.octet_length(whole).cast("long"))
        .withColumn("n_tokens", count(whole))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
