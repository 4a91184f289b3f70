"""The automata against a plain matcher, and the scan against plain counts."""

import random
import re
from functools import cache

import pytest

from threadwise.llm import license_scan
from threadwise.llm.license_scan import TEMPLATES, compiled, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(markup):
    """The markup as nested lists: words, ("any", least, most), optional lists."""
    stack = [[]]
    for token in re.findall(r"<<[^>]*>>|[^\s<>.,;:()\"'/!-]+", markup):
        if token == "<<beginOptional>>":
            stack.append([])
        elif token == "<<endOptional>>":
            inner = stack.pop()
            stack[-1].append(inner)
        elif token.startswith("<<var"):
            stack[-1].append(("any", *map(int, re.search(r'words="(\d+)-(\d+)"', token).groups())))
        else:
            stack[-1].append(frozenset(lower(token).split("|")))
    (result,) = stack
    return result


def ends(parts, words, start):
    """All places where ``parts`` can end that begins at ``start``, by plain recursion."""
    def walk(sequence, places):
        for part in sequence:
            if isinstance(part, frozenset):
                places = {p + 1 for p in places if p < len(words) and words[p] in part}
            elif isinstance(part, tuple):
                _, least, most = part
                places = {
                    p + n for p in places for n in range(least, most + 1) if p + n <= len(words)
                }
            else:
                places = places | walk(part, places)
        return places

    return walk(parts, {start})


@cache
def trees():
    return [(label, weight, tree(markup)) for label, weight, markup in TEMPLATES]


def plain(text):
    words = WORD.findall(lower(text or ""))
    base = []
    for phrase, label in PHRASES.items():
        size = len(phrase.split())
        base += [(i, label) for i in range(len(words)) if words[i : i + size] == phrase.split()]
    accepted = []
    for label, weight, parts in trees():
        starts = [i for i, word in enumerate(words) if word in parts[0]]
        if any(ends(parts, words, i) for i in starts):
            accepted.append((label, weight))
    labels = {label for _, label in base}
    return (
        len(words),
        len(base),
        min((i for i, _ in base), default=None),
        max((i for i, _ in base), default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {label for label, _ in accepted})),
        max([w for _, w in accepted] + [0.5] * bool(base), default=0.0),
    )


def written(markup, rng):
    """A text that a template accepts, in any case and with any separators."""
    def words(parts):
        for part in parts:
            if isinstance(part, frozenset):
                yield rng.choice(sorted(part))
            elif isinstance(part, tuple):
                yield from ["Zoë", "2024", "the", "ACME"][: rng.randint(part[1], min(part[2], 4))]
            elif rng.random() < 0.5:
                yield from words(part)

    return "".join(
        rng.choice([w, w.upper()]) + rng.choice([" ", "\n", ", ", ' "', "-"]) for w in words(tree(markup))
    )


def found(df):
    names = "n_words n_base first_word last_word base_labels labels score".split()
    return [(row.doc_id, tuple(row[name] for name in names)) for row in df.collect()]


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_every_template_accepts_its_texts_and_no_altered_wording(number):
    label, weight, markup = TEMPLATES[number]
    automaton, rng = compiled(*TEMPLATES[number]), random.Random(number)
    for _ in range(12):
        words = words_of(written(markup, rng))
        padded = [b"before", *words, b"after"]
        assert automaton.end(padded, 1) == len(words) + 1
        plain_words = [w.decode() for w in words]
        mandatory = [part for part in tree(markup) if isinstance(part, frozenset)]
        at = rng.randrange(len(words))
        changed = [*plain_words[:at], "qqq", *plain_words[at + 1 :]]
        want = bool(ends(tree(markup), changed, 0))
        assert (automaton.end([w.encode() for w in changed], 0) > 0) == want
        dropped = rng.choice(mandatory)
        kept = [w for w in plain_words if w not in dropped]
        assert automaton.end([w.encode() for w in kept], 0) == -1


def test_random_templates_agree_with_plain_recursion():
    rng = random.Random(3)

    def region(depth):
        parts = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.5 or depth > 2:
                parts.append(rng.choice(["a", "b", "a|c"]))
            elif kind < 0.7:
                low = rng.randint(0, 2)
                parts.append(f'<<var;name="x";words="{low}-{low + rng.randint(0, 3)}">>')
            else:
                parts.append(f"<<beginOptional>>{region(depth + 1)}<<endOptional>>")
        return " ".join(parts)

    for _ in range(400):
        markup = f"{rng.choice('ab')} {region(0)} {rng.choice('ab')}"
        automaton, parts = compiled("x", 1.0, markup), tree(markup)
        for _ in range(10):
            words = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            reached = ends(parts, words, 0)
            got = automaton.end([w.encode() for w in words], 0)
            assert got == min(reached, default=-1), (markup, words)


@pytest.mark.parametrize(
    "markup",
    ["", "<<beginOptional>>a<<endOptional>> b", "a <<beginOptional>>b", "a <<endOptional>> b",
     'a <<var;name="x";words="1-2">>', 'a <<var;name="x";words="3-2">> b',
     'a <<var;name="x";words="1-9999">> b', "a <<other>> b"],
)
def test_faulty_markup_is_refused(markup):
    with pytest.raises(ValueError):
        compiled("x", 1.0, markup)


def texts():
    rng = random.Random(5)
    made = [written(markup, rng) for _, _, markup in TEMPLATES]
    return [
        *made,
        *[f"Some words. {a} and then {b}" for a, b in zip(made, reversed(made))],
        "under the MIT license under the mit license, cc-by-nc / CC BY NC SA",
        "Released under the MIT License. " * 500,
        "permission is hereby granted " * 3000,
        "is free software you can redistribute it " * 400 + "Größe ©2020 \x00 É",
        "not licensed under the mıt license; Apache Licence, version 2.0",
    ]


def test_equals_plain_scan(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(found(license_scan.with_licenses(docs)))
    for doc_id, text in rows:
        assert got[doc_id] == plain(text), text[:200]


def test_matches_name_their_words(spark):
    docs = spark.createDataFrame([("It is released under the MIT License.",)], "text string")
    row = license_scan.with_licenses(docs).first()
    assert row.matches == "mit:2:7" and row.first_word == 3


def test_awkward_rows(spark, awkward, nothing):
    want = sorted((repr(r.doc_id), repr(plain(r.text))) for r in awkward.collect())
    got = found(license_scan.with_licenses(awkward))
    assert sorted((repr(doc_id), repr(values)) for doc_id, values in got) == want
    assert license_scan.with_licenses(nothing).count() == 0


def test_clashing_names(awkward):
    taken = "n_words n_base FIRST_WORD labels licenses matches score".split()
    docs = awkward.selectExpr("*", *[f"'own' AS {name}" for name in taken])
    result = license_scan.with_licenses(docs)
    assert result.columns == [*awkward.columns, "licenses", *license_scan.FOUND.names]
    assert result.first()["licenses"] == "own"
