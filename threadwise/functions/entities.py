"""HTML character references as column expressions, with the results HTML5 prescribes."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"
# Looked up first, since nearly all references are one of these.
FREQUENT = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;")


def _windows_1252(code: int) -> str:
    """What a reference to a control code of the upper range stands for."""
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


def _table(values: dict) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(key) for key in values]), F.array(*[F.lit(value) for value in values.values()])
    )


def _character(code: Column) -> Column:
    """The character of a code point up to 0x10FFFF."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric(digits: Column, base: int) -> Column:
    number = F.regexp_replace(digits, "^0+", "")
    code = F.when(number == "", F.lit(0)).otherwise(F.conv(number, base, 10).cast("long"))
    in_plane = F.pmod(code, F.lit(0x10000))
    nothing = (
        code.between(1, 8)
        | (code == 0xB)
        | code.between(0xE, 0x1F)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | (in_plane >= 0xFFFE)
    )
    upper_controls = _table({code: _windows_1252(code) for code in range(0x80, 0xA0)})
    return (
        F.when(F.length(number) > 7, REPLACEMENT)
        .when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), REPLACEMENT)
        .when(code.between(0x80, 0x9F), F.element_at(upper_controls, code.cast("int")))
        .when(nothing, "")
        .otherwise(_character(code))
    )


def _named(name: Column) -> Column:
    """A named reference; some names need no semicolon, and the longest of those counts."""
    ordered = {key: html5[key] for key in FREQUENT} | html5
    bare = sorted((key for key in html5 if not key.endswith(";")), key=len, reverse=True)
    start = F.regexp_extract(name, f"^(?:{'|'.join(bare)})", 0)
    known = F.element_at(_table(ordered), name)
    from_start = F.concat(
        F.element_at(_table({key: html5[key] for key in bare}), start),
        F.substring(name, F.length(start) + 1, F.length(name)),
    )
    return F.coalesce(
        known, F.when(start != "", from_start), F.concat(F.lit("&"), name)
    )


def decode_reference(reference: Column) -> Column:
    """The text that one reference, as matched by ``REFERENCE``, stands for."""
    body = F.regexp_replace(reference, "^&|;$", "")
    return (
        F.when(reference.rlike("^&#[xX]"), _numeric(F.substring(body, 3, 100_000), 16))
        .when(reference.startswith("&#"), _numeric(F.substring(body, 2, 100_000), 10))
        .otherwise(_named(F.substring(reference, 2, 100)))
    )


def unescape_html5(text: Column) -> Column:
    """Decode every character reference; texts without an ampersand are left alone."""
    references = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    between = F.split(text, REFERENCE, -1)
    decoded = F.zip_with(
        references,
        F.slice(between, 2, F.size(references)),
        lambda reference, rest: F.concat(decode_reference(reference), rest),
    )
    whole = F.concat(F.element_at(between, 1), F.array_join(decoded, ""))
    return F.when(F.contains(text, F.lit("&")) & text.rlike(REFERENCE), whole).otherwise(text)
