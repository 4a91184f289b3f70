import hashlib

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadwise.llm import pii


@given(st.text(alphabet="0123456789.+-() @a%é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute.base_spans(text)


def test_overlong_parts_and_runs():
    text = "1." * 5000 + "9" * 30_000 + "@" * 2000 + "+1" + " " * 5000
    assert pii.base_spans(text) == brute.base_spans(text)
    assert pii.base_spans("1.2.3." + "9" * 5000)["ip"] == []
    assert pii.base_spans("1.2.3." + "0" * 5000 + "4")["ip"] == [(0, 5007)]


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 please", ["iban"]),
        ("IBAN DE89 3704 0044 0532 0130 01 please", []),
        ("my social security number is 123-45-6789", ["ssn"]),
        ("part number 123-45-6789", []),
        ("call me: 030 555 1234 today", ["phone"]),
        ("invoice 030 555 1234 today", []),
        ("amex card 3782 822463 10005", ["card"]),
        ("serial 3782 822463 10005", []),
        # Base patterns take such runs whole and drop them; the parts are still found.
        ("4111111111111111 5500005555555559", ["card"]),
        ("+1 (555) 010-9999 10.0.0.1 4111 1111 1111 1112", ["ip", "phone"]),
        ("order 4111111111111111 5500005555555559", []),
    ],
)
def test_context(text, kinds):
    assert list(pii.find_spans(text)[1]) == kinds


@pytest.mark.parametrize(
    "before, account, after",
    [
        ("", "DE89 3704 0044 0532 0130 00", " I sent"),
        ("", "DE89370400440532013000", " EUR 500"),
        ("", "DE89 3704 0044 0532 0130 00", " BIC COBADEFF"),
        ("", "GB29 NWBK 6016 1331 9268 19", " UK"),
        ("to ", "de89 3704 0044 0532 0130 00", " 12 34"),
        ("to ", "gb29nwbk60161331926819", "."),
        ("AT61 ", "DE89 3704 0044 0532 0130 00", " 7"),
    ],
)
def test_accounts_end_at_their_length(before, account, after):
    text = before + account + after
    assert pii.find_spans(text)[1].get("iban") == [(len(before), len(before + account))]
    assert pii.mask(text) == f"{before}[IBAN]{after}"


@pytest.mark.parametrize(
    "text",
    ["DE89370400440532013000EUR", "XDE89370400440532013000", "DE89  3704 0044 0532 0130 00",
     "DE89 3704 0044 0532 0130", "XX89 3704 0044 0532 0130 00"],
)
def test_no_accounts(text):
    assert "iban" not in pii.find_spans(text)[1]


def test_query_columns(awkward):
    for row in pii.with_pii(awkward).collect():
        base = brute.base_spans(row.text or "")
        written = ",".join(f"{k}:{s}:{e}" for k, spans in base.items() for s, e in spans)
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(s) for s in base.values()]
        assert set(filter(None, written.split(","))) <= set(row.spans.split(","))


def test_masking(clashing):
    masked = pii.masked(clashing)
    assert masked.columns == clashing.columns
    row = masked.filter("doc_id = 8").first()
    assert row.text == "[EMAIL] [PHONE], [IP], [CARD]"
    assert row.n_chars == len(row.text)
    assert masked.filter("text IS NULL").count() == 1
    assert masked.filter("doc_id = 1").first().n_chars == 5
    assert row.pii == "own"


def test_empty(nothing):
    assert pii.with_pii(nothing).count() == 0
    assert pii.masked(nothing).columns == nothing.columns
