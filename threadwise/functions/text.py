"""Text and key normalisation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadwise.functions.entities import unescape_html5
from threadwise.functions.regex import SPACE, SPACE_CLASS, WORD

# Entities the native decoder knows, in decoding order. The ampersand comes last so that a
# doubly escaped entity is unescaped by one level only.
COMMON_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)


def unescape_common(text: Column) -> Column:
    """Decode the entities message exports contain, inside the JVM."""
    for entity, plain in COMMON_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_text(text: Column, entities: str = "common") -> Column:
    """Unescape, collapse white space, trim; null becomes the empty string.

    ``entities="common"`` decodes what message exports contain, ``"html5"`` every reference.
    """
    decode = {"common": unescape_common, "html5": unescape_html5}[entities]
    return F.coalesce(collapse_space(decode(text)), F.lit(""))


def strip_handles(text: Column, entities: str = "common") -> Column:
    """Clean ``text`` and drop leading @handles; keep ``text`` as it was if nothing remains."""
    cleaned = clean_text(text, entities)
    rest = F.trim(F.regexp_replace(cleaned, f"^(?:@{WORD}+{SPACE}*)+", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), text)


def clean_key(key: Column) -> Column:
    """``"123.0"`` becomes ``"123"``."""
    return F.substring_index(key.cast("string"), ".", 1)


def lower_string(value: Column) -> Column:
    return F.lower(value.cast("string"))


def key_list(keys: Column) -> Column:
    """The cleaned, non-empty keys of a comma-separated list, as an array."""
    parts = F.transform(F.split(keys, ","), lambda part: clean_key(F.trim(part)))
    return F.filter(parts, lambda part: part != "")


def long_words(text: Column) -> Column:
    """Words of more than three characters after punctuation is removed, repeats kept."""
    bare = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}]", "")
    return F.filter(F.split(bare, f"{SPACE}+"), lambda word: F.length(word) > 3)


def term_set(text: Column) -> Column:
    """Distinct ASCII words of four or more characters, letters and apostrophes only."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z']+"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda word: F.length(word) >= 4)


def word_tokens(text: Column) -> Column:
    """Lower-cased words of two or more characters, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{2,}}"), F.lit(0))


def drop_words(tokens: Column, stop_words: list[str]) -> Column:
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(*stop_words))


def unigrams_and_bigrams(tokens: Column) -> Column:
    """The tokens followed by every adjacent pair, joined by a space."""
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda left, right: F.concat_ws(" ", left, right),
    )
    return F.concat(tokens, pairs)


def shorten(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))
