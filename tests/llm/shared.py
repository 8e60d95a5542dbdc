from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, content string, kept int, hash string"


@pytest.fixture
def documents(spark):
    """Builds a documents table from texts; other columns clash with names the operators use."""

    def build(texts, langs=None, first=0):
        rows = [
            (first + k, t, langs[k] if langs else "en", None, None, "r", "c", 7, "h") for k, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS)

    return build


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words; the same seed gives the same text."""

    def write(seed, words=60):
        rng = random.Random(seed)
        out = []
        for k in range(words):
            word = "".join(rng.choice(["ba", "de", "lo", "mi", "ru", "sta", "ven", "kor"]) for _ in range(rng.randint(1, 4)))
            out.append(word.capitalize() if k % 9 == 0 else word + ("." if k % 9 == 8 else ""))
        return " ".join(out)

    return write


#: NULL, empty, blank, without letters, very long, special characters, repeated.
ODD = [None, "", " \t\n", "...", "12 34", "x", "x", "é ñ ß 中文", "word " * 30_000, "a" * 200_000, "\u0000b", "<|endoftext|> 's"]


@pytest.fixture
def odd():
    return list(ODD)
