import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix odd potions daily"


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, one hot source."""
    long_text = " ".join(f"{PROSE} {i}" for i in range(2000))
    rows = [
        (1, PROSE * 9, "en", "a", 5),
        (1, PROSE * 9, "en", "a", 5),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "de", "b", 3),
        (None, "no id here", "en", "a", 10),
        (None, "no id here", "en", "a", 10),
        (5, long_text, "en", "c", len(long_text)),
        (6, "x" * 120_000, "en", None, 120_000),
        (7, "Größe naïve 日本語 😀 é ▁ <|endoftext|> İ", "de", "b", 30),
        (8, "a@b.example.com +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111", "en", "a", 60),
        (9, "line one\nline one\nline two\n\n" * 30, "en", "b", 800),
    ]
    rows += [(100 + i, f"{PROSE} number {i} " * (i % 7 + 4), "en", "a", 1) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns that are named like the operators' own."""
    names = (
        "size taken target mix_order fingerprint component_id spans n_email kept n_words ids pieces "
        "n_tokens score toxicity prediction probability n_bytes row start clean_text pii"
    )
    return awkward.selectExpr("*", *[f"'own' AS {name}" for name in names.split()])
