from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, root long, key long, uid long, h long, shard string, size string, y int, part int, __row long, __text string, row_key string, text_as_string int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with further columns whose names clash with those that operators use."""

    def make(*docs):
        return spark.createDataFrame([(d[0], d[1], "en", d[2] if len(d) > 2 else "s", 1, 7, 7, 7, 7, 7, "old", "x", 3, 9, 77, "own", "key", 5) for d in docs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n invented words."""

    def f(n: int, seed: int = 0) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choice(["ba", "ko", "ti", "re", "mun", "sel", "dor"]) for _ in range(r.randint(1, 4))) for _ in range(n))

    return f


@pytest.fixture(scope="session")
def edge_docs(make_docs, prose):
    """Null, empty and blank texts, null and repeated ids, repeated rows, a very long text, unusual characters."""
    long = prose(30_000, 1)
    return make_docs((1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "one two three"), (5, "ünï cödé 数据 <|endoftext|>  x   y"), (6, long), (7, long), (8, "same id a b c"), (8, "another text x y z", None), (9, prose(40, 3), None))


@pytest.fixture(scope="session")
def no_docs(make_docs, spark):
    return spark.createDataFrame([], SCHEMA)
