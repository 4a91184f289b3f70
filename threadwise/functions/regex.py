"""Regex classes that mean the same in every engine.

``\\w``, ``\\s`` and ``\\b`` differ between regex engines and JDK releases, so patterns are
written with explicit Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character: any letter, any number, or the underscore.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
# Every Unicode white-space character.
SPACE_CLASS = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = f"[{SPACE_CLASS}]"

WORD_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
# Unix-lines mode: "." stops at a line feed and at nothing else.
DOT_STOPS_AT_LF = "(?d)"


def portable(pattern: str) -> str:
    """Rewrite ``\\b`` as an explicit Unicode word boundary."""
    return DOT_STOPS_AT_LF + pattern.replace(r"\b", WORD_BOUNDARY)


def search(text: Column, pattern: str) -> Column:
    """True where ``pattern`` occurs anywhere in ``text``."""
    return text.rlike(portable(pattern))


def escape(literal: str) -> str:
    """Quote a literal for use inside a pattern."""
    return "".join(ch if ch.isalnum() or ch in " _'" else "\\" + ch for ch in literal)


def word_pattern(literal: str) -> str:
    """A pattern for ``literal`` as a whole word."""
    first = "<!" if literal[0].isalnum() or literal[0] == "_" else "<="
    last = "?!" if literal[-1].isalnum() or literal[-1] == "_" else "?="
    return f"(?{first}{WORD}){escape(literal)}({last}{WORD})"


def words_found(text: Column, entries: Column) -> Column:
    """Those of ``entries``, an array of (literal, pattern, ...), that occur in ``text``.

    The cheap substring test comes first, so a pattern only runs where its literal occurs.
    """
    return F.filter(
        entries, lambda e: F.contains(text, e["literal"]) & F.rlike(text, e["pattern"])
    )
