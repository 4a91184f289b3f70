"""Personal data: patterns propose spans, validators confirm them, context adjusts a score.

Each kind of data has a pattern, a validator and a starting score. The confirmed spans of the base
kinds (email, ip, card, phone) always stay. Further kinds and looser forms only become spans when
their validator passes and their score reaches a threshold; words near the span that speak for the
kind raise the score, words that speak for a mere number lower it.

Defined results: null text is the empty text and has no spans; spans are in code points, end
exclusive, without overlap within a kind; an added span never overlaps a base span; equal rows give
equal spans; an empty table gives an empty table. Input columns named like a column the operator
adds are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.llm.common import drop_columns, set_aside, whole_text

BASE_KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.6
# Code points on either side of a span in which words count as its context.
CONTEXT = 48

Span = tuple[int, int]


# --- validators --------------------------------------------------------------------------------


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers: letters count from 10, the rest is 1."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _is_ip(match: re.Match) -> bool:
    parts = (part.lstrip("0") for part in match.group().split("."))
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def _is_card(match: re.Match) -> bool:
    number = digits(match.group())
    return 16 <= len(number) <= 19 and luhn(number)


def _is_phone(match: re.Match) -> bool:
    return 8 <= len(digits(match.group())) <= 15


# Registered lengths of account numbers by country (public standard).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "TR": 26,
}


def _is_iban(match: re.Match) -> bool:
    return mod97(match["span"].replace(" ", "").upper())


def _is_short_card(match: re.Match) -> bool:
    number = digits(match.group())
    return len(number) == 15 and number[:2] in ("34", "37") and luhn(number)


def _is_ssn(match: re.Match) -> bool:
    area, group, serial = match.group().split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _is_national_phone(match: re.Match) -> bool:
    return 9 <= len(digits(match.group())) <= 11


# --- patterns ----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of these starts inside a run of digits, so long runs are passed over once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Exactly as many characters as the country registered. The match itself is empty, so that an
# account is also found behind a start that turned out to be none.
_IBAN = re.compile(
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?=(?P<span>(?:"
    + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())
    + r")(?![A-Z0-9])))",
    re.ASCII | re.IGNORECASE,
)


def emails(text: str) -> list[Span]:
    """Leftmost addresses. An @ is looked for first and the local part is read backwards."""
    spans: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            spans.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return spans


def _confirmed(pattern: re.Pattern, valid: Callable[[re.Match], bool], text: str) -> list[Span]:
    return [match.span() for match in pattern.finditer(text) if valid(match)]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost, non-overlapping, confirmed spans of the base kinds."""
    return {
        "email": emails(text),
        "ip": _confirmed(_IP, _is_ip, text),
        "card": _confirmed(_CARD, _is_card, text),
        "phone": _confirmed(_PHONE, _is_phone, text),
    }


@dataclass(frozen=True)
class Kind:
    """A further kind of span: kept from ``THRESHOLD`` on, context words included.

    The span is the pattern's group of that name, or the whole match.
    """

    name: str
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    score: float
    words_for: re.Pattern
    words_against: re.Pattern


def _words(*words: str) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE)


_NUMBERING = _words(
    "order", "invoice", "version", "part", "item", "page", "figure", "serial", "model", "isbn",
    "bestellung", "rechnung", "seite", "commande", "facture", "pedido", "factura",
)
_TELEPHONE = _words(
    "phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "telefon", "anruf",
    "handy", "téléphone", "appelez", "portable", "teléfono", "llame", "móvil",
)
_CARDS = _words("card", "credit", "amex", "visa", "payment", "karte", "carte", "tarjeta")
_ACCOUNTS = _words("iban", "account", "bank", "konto", "compte", "cuenta", "transfer")
_SECURITY = _words("ssn", "social", "security", "taxpayer")

EXTRA_KINDS = (
    # Four groups of four, and an international number in its usual form: the base patterns take a
    # longer run of digits whole, and drop it.
    Kind(
        "card",
        re.compile(r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
        _is_card, 0.7, _CARDS, _NUMBERING,
    ),
    Kind(
        "phone",
        re.compile(
            r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?"
            r"(?:[0-9](?:[\x20.-][0-9]{2}){4}|[0-9]{2,4}(?:[\x20.-][0-9]{3,4}){1,2})(?![0-9])"
        ),
        _is_phone, 0.7, _TELEPHONE, _NUMBERING,
    ),
    Kind(
        "card",
        re.compile(r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"),
        _is_short_card, 0.5, _CARDS, _NUMBERING,
    ),
    Kind(
        "phone",
        re.compile(
            r"(?<![0-9+.-])(?:\(0?[0-9]{2,4}\)\x20?|0?[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{3,4}"
            r"(?![0-9.-])"
        ),
        _is_national_phone, 0.3, _TELEPHONE, _NUMBERING,
    ),
    Kind(
        "iban",
        _IBAN, _is_iban, 0.9, _ACCOUNTS, _NUMBERING,
    ),
    Kind(
        "ssn",
        re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        _is_ssn, 0.4, _SECURITY, _NUMBERING,
    ),
)
KINDS = (*BASE_KINDS, "iban", "ssn")


def context_score(text: str, start: int, end: int, kind: Kind) -> float:
    """The kind's score, moved by words before and behind the span."""
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    score = kind.score
    score += 0.4 * bool(kind.words_for.search(near))
    score -= 0.3 * bool(kind.words_against.search(near))
    return score


def merged(spans: Iterable[Span]) -> list[Span]:
    """Sorted spans without overlap that cover the given ones."""
    result: list[Span] = []
    for start, end in sorted(spans):
        if result and start < result[-1][1]:
            result[-1] = (result[-1][0], max(end, result[-1][1]))
        else:
            result.append((start, end))
    return result


def overlaps(taken: list[Span], start: int, end: int) -> bool:
    """Whether a span meets one of the merged spans."""
    place = bisect_right(taken, (end,))
    return place > 0 and taken[place - 1][1] > start


def find_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind."""
    base = base_spans(text)
    taken = merged(span for spans in base.values() for span in spans)
    added: dict[str, list[Span]] = {}
    for kind in EXTRA_KINDS:
        for match in kind.pattern.finditer(text):
            start, end = match.span("span" if "span" in kind.pattern.groupindex else 0)
            if overlaps(taken, start, end) or not kind.valid(match):
                continue
            if context_score(text, start, end, kind) >= THRESHOLD:
                added.setdefault(kind.name, []).append((start, end))
                insort(taken, (start, end))
    return base, {
        kind: sorted(base.get(kind, []) + added.get(kind, []))
        for kind in KINDS
        if base.get(kind) or added.get(kind)
    }


def written(spans: dict[str, list[Span]]) -> str:
    """kind:start:end by kind, then start, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans.get(k, []))


# --- Spark -------------------------------------------------------------------------------------

FOUND = T.StructType(
    [T.StructField(f"n_{kind}", T.LongType()) for kind in BASE_KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)
ADDED = tuple(field.name for field in FOUND) + ("pii", "pii_masked")


def _found(text: str) -> tuple:
    base, spans = find_spans(text)
    digest = hashlib.sha256(written(base).encode()).hexdigest()
    return (*(len(base[kind]) for kind in BASE_KINDS), digest, written(spans))


def with_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts of base spans, the digest of the base spans, and all spans."""

    @F.pandas_udf(FOUND)
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(map(_found, texts), columns=FOUND.names)

    found = drop_columns(docs, *ADDED).withColumn("pii", detect(whole_text(text)))
    return found.select("*", "pii.*").drop("pii")


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlaps become one mask."""
    _, spans = find_spans(text)
    pieces, free = [], 0
    for start, end, kind in sorted((s, e, k) for k, found in spans.items() for s, e in found):
        if start >= free:
            pieces += [text[free:start], f"[{kind.upper()}]"]
        free = max(free, end)
    return "".join(pieces) + text[free:]


def masked(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """Documents with personal data masked and their length adjusted; null texts stay null."""

    @F.pandas_udf("string")
    def mask_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else mask(t) for t in texts], dtype=object)

    inputs, restored = set_aside(docs, ADDED)
    result = inputs.withColumn("pii_masked", mask_all(F.col(text)))
    if length in docs.columns:
        changed = ~F.col("pii_masked").eqNullSafe(F.col(text))
        result = result.withColumn(
            length,
            F.when(changed, F.length("pii_masked").cast(docs.schema[length].dataType)).otherwise(
                F.col(length)
            ),
        )
    return result.withColumn(text, F.col("pii_masked")).select(*restored)
