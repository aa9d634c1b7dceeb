from __future__ import annotations

import random

import pytest

SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if i % 17 == 16 else " ") for i, w in enumerate(words)).strip()


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, one-word, repeated, tied and very long texts, with null ids and null hosts."""
    long = prose(5, 30_000)
    base = prose(1, 200)
    texts = [None, "", " \t\n ", "one", "one two three", base, base, base.replace("ba", "BA"), base + " tail", prose(2, 300), long, long + " x", "a  b\n\n cé 日本語 \U0001f600 <|endoftext|>", "x" * 50_000, "y " * 5000]
    rows = [(i, t, "en", f"h{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[9], (None, base, "en", "h1", 1), (None, None, None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns with names that operators might use themselves."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("keep") for c in ("node", "label", "digest", "n", "row", "items", "word", "kept_", "host", "a", "b")})
