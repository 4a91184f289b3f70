import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadwise.llm import bitplanes

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = bitplanes.Encoder(TOKENIZER)


def library(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70), st.sampled_from([1, 8]))
@settings(max_examples=100, deadline=None)
def test_planes(ids, plane_bits):
    values = np.array(ids, dtype=np.uint32)
    planes = bitplanes.to_planes(values, plane_bits)
    assert len(planes) == 32 // plane_bits
    assert bitplanes.from_planes(planes, len(values), plane_bits).tolist() == ids


@given(st.binary(max_size=40), st.binary(max_size=40))
@settings(max_examples=100, deadline=None)
def test_crc32_combine(a, b):
    assert bitplanes.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@given(st.text(alphabet="ab' \n\t\x1c 9.é日😀", max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == library(text)


def test_special_strings():
    for text in ("a <|endoftext|>b", "<|endoftext|>", " x <|endoftext|> <|endoftext|>"):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == library(text)


@pytest.mark.parametrize("block_ids, plane_bits", [(16, 8), (1000, 1), (65_536, 8)])
def test_files(spark, awkward, tmp_path, block_ids, plane_bits):
    path = str(tmp_path / "ids")
    bitplanes.write_ids(awkward, path, PATH, 2, block_ids=block_ids, plane_bits=plane_bits)
    rows = [(r.doc_id, [*library(r.text), 2]) for r in awkward.collect()]
    key = lambda row: (row[0] is not None, row[0] or 0, row[1])
    read = [(r.doc_id, list(r.ids)) for r in bitplanes.read_documents(spark, path).collect()]
    assert sorted(read, key=key) == sorted(rows, key=key)
    digests = sorted(bitplanes.read_digests(spark, path, block_ids).collect(), key=lambda r: r.start)
    at = 0
    for row in digests:
        assert row.start == at
        at += row.n_tokens
    ids = [r.doc_id for r in digests]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted((str(i), len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in digests) == want
    sizes = bitplanes.read_blocks(spark, path).select("shard", "block", "n_ids").collect()
    last = {s: max(b.block for b in sizes if b.shard == s) for s in {b.shard for b in sizes}}
    assert all(b.n_ids == block_ids for b in sizes if b.block < last[b.shard])


def test_empty(spark, nothing, tmp_path):
    bitplanes.write_ids(nothing, str(tmp_path / "ids"), PATH, 2)
    assert bitplanes.read_digests(spark, str(tmp_path / "ids")).count() == 0
    assert bitplanes.read_documents(spark, str(tmp_path / "ids")).count() == 0
