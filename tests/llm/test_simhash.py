import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadwise.llm import simhash


def unsigned(value):
    return value & (1 << 64) - 1


@given(st.text(alphabet="aB \t\n\x0bé ", max_size=60))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert unsigned(simhash.fingerprint(text)) == brute.fingerprint(text)


@pytest.mark.parametrize("errors", [0, 1, 3, 4, 6])
def test_trie_finds_all_links(spark, errors):
    rng = random.Random(errors)
    values = {rng.getrandbits(64) for _ in range(60)}
    for value in list(values)[:30]:
        for _ in range(4):
            flips = rng.sample(range(64), rng.randint(1, errors + 2))
            values.add(value ^ sum(1 << bit for bit in flips))
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    nodes = spark.createDataFrame([(v, v) for v in signed], "doc_id long, fingerprint long")
    found = simhash.near_duplicates(nodes, errors=errors).collect()
    want = brute.component_ids([(v, unsigned(v)) for v in signed], errors)
    assert {r.doc_id: r.component_id for r in found} == dict(zip(signed, want))


def test_long_chain(spark):
    """Each value is linked with the next only, so the component is one path."""
    values = [0]
    for i in range(60):
        values.append(values[-1] ^ (0b111 << (i % 21 * 3)) ^ (i << 40 & 1 << 63))
    values = sorted(set(values))
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fingerprint long")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(nodes).collect()}
    want = brute.component_ids(list(enumerate(map(unsigned, signed))))
    assert found == dict(enumerate(want))


def test_equals_brute_force(awkward):
    found = simhash.near_duplicates(simhash.with_fingerprint(awkward)).collect()
    rows = [(r.doc_id, unsigned(r.fingerprint)) for r in found]
    assert [f for _, f in rows] == [brute.fingerprint(r.text) for r in found]
    assert [r.component_id for r in found] == brute.component_ids(rows)


def test_one_stays(clashing):
    kept = simhash.deduplicated(clashing)
    assert kept.columns == clashing.columns
    rows = [(r.doc_id, brute.fingerprint(r.text)) for r in clashing.collect()]
    assert kept.count() == len(set(map(str, brute.component_ids(rows))))
    assert kept.filter("doc_id = 1").count() == 1


def test_empty(nothing):
    assert simhash.near_duplicates(simhash.with_fingerprint(nothing)).count() == 0
    assert simhash.deduplicated(nothing).columns == nothing.columns
