import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadwise.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = token_counts.load(PATH)
PROVEN = token_counts.proven_tokens(TOKENIZER)
COUNTS = token_counts.ChunkCounts(TOKENIZER, PROVEN)


def library(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_proof():
    vocabulary = TOKENIZER.get_vocab()
    assert len(PROVEN) > 10_000
    assert all(word + "</w>" in vocabulary for word in PROVEN)
    for word in sorted(PROVEN)[::997]:
        assert len(TOKENIZER.model.tokenize(word)) == 1


@given(st.text(alphabet="aeTHE's 09.!\n\t\x1c é́İß日😀<|>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts_equal_library(text):
    assert COUNTS.total(text) == library(text)


def test_special_strings():
    for text in ("a <|endoftext|>b", "<|startoftext|> <|endoftext|>", "x<|endoftext|>y z"):
        assert COUNTS.total(text) == library(text)


def test_remembers_a_bounded_number(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counts = token_counts.ChunkCounts(TOKENIZER, PROVEN)
    assert counts.total("one two three four five six") == 6
    assert len(counts) <= 3


def test_query(clashing, nothing):
    for row in token_counts.with_token_counts(clashing, PATH).collect():
        text = row.text or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), library(text))
        assert row.over_limit == (row.n_tokens > 2048)
    assert token_counts.with_token_counts(nothing, PATH).count() == 0


def test_spaced_pre_tokens_are_refused():
    with pytest.raises(ValueError, match="spaces"):
        token_counts.check_spaces(token_counts.load(public_tokenizers.path("byte_bpe_50k.json")))
