"""The registered queries against their SQL, and those without SQL for their contract."""

import oracle
import pytest
from pathlib import Path

from threadwise import llm

TESTDATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are absent")
QUERIES, SQL = llm.queries(), llm.oracle_sql()

COLUMNS = {
    "op1_bitplanes": "doc_id start n_tokens ids_crc32",
    "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_line_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_mixing": "doc_id size source_size target taken",
    "op6_onebit_search": "query_id rank vec_id score",
    "op7_page_text": "page_id url text n_chars",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op11_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    found = oracle.differences(
        QUERIES[name](spark, str(TESTDATA)), oracle.connect(str(TESTDATA)), SQL[name]
    )
    assert not found, "\n".join(found)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert QUERIES[name](spark, str(TESTDATA)).columns == COLUMNS[name].split()


def test_one_query_per_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
