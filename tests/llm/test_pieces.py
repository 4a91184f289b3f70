import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from threadwise.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.load(PATH)


@given(st.text(alphabet="aeinrst ▁\n.-=#09Éß²日😀", max_size=80))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library(text):
    ids = pieces.Encoder(MODEL, {}).encode(text).tolist()
    assert ids == LIBRARY.encode(text)
    assert pieces.decode_ids(ids, MODEL) == LIBRARY.decode(ids) == text.replace("▁", " ")


def test_decoding_at_once_equals_decoding_one_by_one(monkeypatch):
    monkeypatch.setattr(pieces, "DECODED_AT_ONCE", 3)
    texts = ["", "a", " two  words", "▁x Größe 日本 😀", "last\n"]
    lists = [LIBRARY.encode(text) for text in texts]
    ids = np.array([number for found in lists for number in found], dtype=np.int32)
    offsets = np.cumsum([0, *map(len, lists)])
    decoder = pieces.Decoder(MODEL)
    assert decoder.decode(ids).decode() == "".join(
        b"".join(MODEL.texts[n] for n in found).decode() for found in lists
    )
    assert decoder.matches(ids, offsets, texts) == [True] * 5
    assert decoder.matches(ids, offsets, ["", "b", "two words", "x", "last"]) == [True] + [False] * 4


def test_other_models_are_refused(monkeypatch):
    class Unigram(sentencepiece.SentencePieceProcessor):
        def get_score(self, number):
            return super().get_score(number) - 0.5

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.load(PATH)

    class Folding(sentencepiece.SentencePieceProcessor.__mro__[1]):
        def encode(self, text):
            return super().encode(text.strip())

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="spaces"):
        pieces.load(PATH)


def test_lattice_equals_library(spark, awkward):
    units = pieces.frequent_units(pieces.count_units(awkward))
    rows = pieces.folded_units(units, MODEL).collect()
    assert len(rows) > 30
    assert all(list(row.ids) == pieces.fold_unit(row.unit, MODEL) for row in rows)


def test_frequent_units_are_bounded(awkward):
    counts = pieces.count_units(awkward)
    assert pieces.frequent_units(counts, 5).count() == 5
    assert counts.filter("length(unit) > 62").count() > 0
    assert pieces.frequent_units(counts).filter("length(unit) > 62").count() == 0


def test_encoded(clashing):
    rows = pieces.encoded(clashing, PATH, check=True).collect()
    for row in rows:
        assert list(row.ids) == LIBRARY.encode(row.text or "")
        assert row.n_tokens == len(row.ids) and row.decoded


def test_round_trip(spark, awkward):
    encoded = pieces.encoded(awkward.filter("doc_id <> 7"), PATH)
    back = pieces.decoded(encoded.withColumnRenamed("ids", "tokens"), PATH, "tokens")
    assert all(row.decoded == (row.text or "") for row in back.collect())


def test_empty(nothing):
    assert pieces.encoded(nothing, PATH).count() == 0


def test_pieces_across_units_are_refused(monkeypatch):
    monkeypatch.setattr(pieces, "UNIT", r"\p{L}")
    with pytest.raises(ValueError, match="across units"):
        pieces.load(PATH)
