"""Licences in texts, found by template markup.

A template is licence wording with regions that may be left out and places where any words may stand
(see ``license_templates``). It is compiled into an automaton over words: one state per word, kept
as bits of one integer, a jump over each optional region and from each place of a replaceable
region to its end. A stretch of a text is accepted when its mandatory wording matches exactly, word
for word and in order. Case, punctuation and line breaks never matter.

Every template starts with mandatory words. A text is searched for those as plain bytes, and the
automaton runs from each such place, at most as far as the template can reach, so the work grows
with the text. Texts stay where they are: the scan is one pass without a shuffle.

Beside the templates, fixed phrases count wherever their words stand consecutively; their labels stay
whatever the templates find. The score is the largest weight of what was found: 1 for a whole
licence or notice, 0.8 for a statement that names one, 0.5 for a mere phrase, 0 for nothing.

Defined results: null text is the empty text and has no words; first and last word are null without
phrases; labels are distinct, sorted and comma-joined, the empty string for none; repeated rows get
equal results; an empty table gives an empty table. Input columns named like a column the operator
adds make way for it, all others are kept.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.llm.common import set_aside, whole_text
from threadwise.llm.license_templates import PHRASE_WEIGHT, PHRASES, TEMPLATES

# In UTF-8, words are runs of digits, lower-case letters and bytes from 80 on; the rest separates.
SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
# Words at the start of a template that are searched for as bytes, and the longest replaceable region.
ANCHOR_WORDS = 4
LONGEST_REGION = 200

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_base", T.LongType(), False),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType(), False),
        T.StructField("labels", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("matches", T.StringType(), False),
    ]
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(TO_SPACE).split()


# --- templates ---------------------------------------------------------------------------------

MARKUP = re.compile(
    r"<<(beginOptional|endOptional)>>"
    r'|<<var;name="[^"]*";words="([0-9]+)-([0-9]+)">>'
    r"|([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+(?:\|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)*)"
)


@dataclass(frozen=True)
class Automaton:
    """States as bits: bit i is set when the first i words of the template's line are consumed."""

    label: str
    weight: float
    anchors: tuple[bytes, ...]
    anchor_words: int
    length: int
    steps: dict[bytes, int]
    any_word: int
    jumps: tuple[tuple[int, int], ...]

    def end(self, words: list[bytes], start: int) -> int:
        """Where the shortest accepted stretch from ``start`` ends, exclusive; -1 without one."""
        states, accepted = self._closed(1), 1 << self.length
        for place in range(start, len(words)):
            states = (states << 1) & (self.steps.get(words[place], 0) | self.any_word)
            if not states:
                return -1
            states = self._closed(states)
            if states & accepted:
                return place + 1
        return -1

    def _closed(self, states: int) -> int:
        for sources, target in self.jumps:
            if states & sources:
                states |= target
        return states


def compiled(label: str, weight: float, markup: str) -> Automaton:
    """The automaton of a template, or an error that says what its markup lacks."""
    left_over = MARKUP.sub("", markup)
    if "<<" in left_over or ">>" in left_over:
        raise ValueError(f"{label}: unknown markup in {left_over.strip()[:80]!r}")
    line: list[tuple[bytes, ...] | None] = []
    jumps, opened, depths = [], [], []
    for match in MARKUP.finditer(markup):
        edge, low, high, word = match.groups()
        if edge == "beginOptional":
            opened.append(len(line))
        elif edge == "endOptional":
            if not opened:
                raise ValueError(f"{label}: a region ends that was never begun")
            begin = opened.pop()
            jumps.append((begin, 1 << begin, 1 << len(line)))
        elif word:
            line.append(tuple(w.encode().lower() for w in word.split("|")))
            depths.append(len(opened))
        else:
            least, most = int(low), int(high)
            if not least <= most <= LONGEST_REGION:
                raise ValueError(f"{label}: a region of {least} to {most} words")
            begin = len(line)
            line += [None] * most
            depths += [1] * most
            sources = sum(1 << place for place in range(begin + least, begin + most))
            if sources:
                jumps.append((begin + least, sources, 1 << (begin + most)))
    if opened:
        raise ValueError(f"{label}: a region is never ended")
    if not line or depths[0] or depths[-1] or None in (line[0], line[-1]):
        raise ValueError(f"{label}: a template starts and ends with mandatory words")
    anchor = list(itertools.takewhile(lambda at: not depths[at], range(min(ANCHOR_WORDS, len(line)))))
    steps: dict[bytes, int] = {}
    for place, allowed in enumerate(line):
        for word in allowed or ():
            steps[word] = steps.get(word, 0) | 1 << (place + 1)
    return Automaton(
        label,
        weight,
        tuple(
            b" " + b" ".join(choice) + b" "
            for choice in dict.fromkeys(itertools.product(*[line[at] for at in anchor]))
        ),
        len(anchor),
        len(line),
        steps,
        sum(1 << (place + 1) for place, allowed in enumerate(line) if allowed is None),
        # In the order of their begins, so that one jump can lead into the next.
        tuple((sources, target) for _, sources, target in sorted(jumps, key=lambda j: j[0])),
    )


# --- texts -------------------------------------------------------------------------------------


def places_of(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Byte places of ``phrase``, overlapping ones included; both have a space at either end."""
    at = joined.find(phrase)
    while at >= 0:
        yield at
        at = joined.find(phrase, at + 1)


def in_words(joined: bytes, places: Iterable[int]) -> list[int]:
    """The numbers of the words that start after these ascending byte places."""
    result, word, before = [], 0, 0
    for at in places:
        word += joined.count(b" ", before, at)
        before = at
        result.append(word)
    return result


def template_matches(
    words: list[bytes], joined: bytes, automata: Iterable[Automaton]
) -> list[tuple[str, int, int, float]]:
    """(label, start, end, weight) of accepted stretches; those of one template don't overlap."""
    result, found = [], {}
    for automaton in automata:
        for anchor in automaton.anchors:
            if anchor not in found:  # many templates start alike
                found[anchor] = list(places_of(joined, anchor))
        places = sorted({at for anchor in automaton.anchors for at in found[anchor]})
        free = 0
        for start in in_words(joined, places):
            if start >= free and (end := automaton.end(words, start)) > 0:
                result.append((automaton.label, start, end, automaton.weight))
                free = end
    return sorted(result, key=lambda m: (m[1], m[2], m[0]))


def scan(text: str, automata: list[Automaton], phrases: list[tuple[bytes, str]]) -> tuple:
    """What a text holds, in the order of ``FOUND``."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in phrases:
        found = in_words(joined, places_of(joined, phrase))
        starts += found
        if found:
            base.add(label)
    matches = template_matches(words, joined, automata)
    labels = base | {label for label, *_ in matches}
    weights = [weight for *_, weight in matches] + [PHRASE_WEIGHT] * bool(base)
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        max(weights, default=0.0),
        ",".join(f"{label}:{start}:{end}" for label, start, end, _ in matches),
    )


# --- Spark -------------------------------------------------------------------------------------


def with_licenses(
    docs: DataFrame,
    text: str = "text",
    templates: Iterable[tuple[str, float, str]] = TEMPLATES,
    phrases: Iterable[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """Add what ``FOUND`` lists to every row; ``matches`` are label:start:end, in words."""
    automata = [compiled(*template) for template in templates]
    sought = [(b" " + b" ".join(words_of(phrase)) + b" ", label) for phrase, label in phrases]

    @F.pandas_udf(FOUND)
    def licenses(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([scan(t, automata, sought) for t in texts], columns=FOUND.names)
        return found.astype({"first_word": "Int64", "last_word": "Int64"})

    inputs, restored = set_aside(docs, ("licenses",))
    scanned = inputs.withColumn("licenses", licenses(whole_text(text)))
    kept = [c for c, name in zip(restored, docs.columns) if name.lower() not in FOUND.names]
    return scanned.select(*kept, *[F.col(f"licenses.{name}").alias(name) for name in FOUND.names])
