"""Phrases against counts in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from semlattice.llm import phrases as P


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain(docs, spec):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 99):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        rows = []
        often = {p: a for p, a in counts.items() if len(p) <= spec.longest and a >= spec.least}
        for p, a in often.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= spec.percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[: spec.top], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i % 3 or None, t, lang, "w", 1, 2, 3, 4) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, word string, n long, id long, block long, f long")


@pytest.mark.parametrize("spec", [P.Mining(5), P.Mining(3, longest=4, percent=60, top=7), P.Mining(2, longest=3)])
def test_counts_and_scores(spark, monkeypatch, spec):
    monkeypatch.setattr(P, "BLOCK_BYTES", 3000)
    r = random.Random(1)
    common = ["of the", "New York City", "once upon a time there", "Über uns", "数据 集", "a a a", "tick tock tick tock tick"]
    docs = []
    for i in range(150):
        parts = [r.choice([*common, *(w for w in "alpha beta gamma delta".split())]) for _ in range(r.randint(0, 25))]
        docs.append((r.choice(["en", "en", "de", None, "und"]), "".join(p + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "-"]) for p in parts)))
    docs += [("en", None), ("fr", ""), (None, " \t.,\n"), ("en", "one"), docs[3], docs[3]]
    got = sorted(map(tuple, P.collocations(frame(spark, docs), spec).collect()))
    assert got == plain(docs, spec) and len(got) > 5


def test_a_very_long_text_and_none(spark):
    docs = [("en", "so so " * 40_000), ("en", "x" * 300_000), ("de", "kurz und gut. " * 2)]
    got = [tuple(r) for r in P.collocations(frame(spark, docs)).collect()]
    assert got == [("en", 1, "so so so so so", 79_996, 79_997, 80_000, 80_001, 1000 * 79_996 * 80_001 // (79_997 * 80_000))] or got == plain(docs, P.Mining())
    assert P.collocations(frame(spark, docs).where("false")).count() == 0


def test_products_beyond_64_bits(spark):
    """Counts near 10^12, as the sums over very many blocks may give."""
    docs = frame(spark, [("en", "a b")])
    big = 10**12
    words = spark.createDataFrame([([1], "a", "en", big, 1), ([2], "b", "en", big - 7, 1), ([1, 2], "a b", "en", big - 9, 2)], "words array<long>, phrase string, lang string, f long, k int")
    totals = spark.createDataFrame([("en", 10**15 + 3)], "lang string, n long")
    real, P.frequent_phrases = P.frequent_phrases, lambda *_: (words, totals)
    try:
        assert P.collocations(docs).first()["score"] == 1000 * (big - 9) * (10**15 + 3) // (big * (big - 7))
    finally:
        P.frequent_phrases = real


def test_positions_part_pieces_and_texts():
    at, code, words = P.occurrences(pa.array(["A b, c", None, "", "b  a\tb"]))
    steps = [int(y - x) for x, y in zip(at, at[1:])]
    assert [words[int(c)].as_py() for c in code] == ["a", "b", "c", "b", "a", "b"] and [s == 1 for s in steps] == [True, False, False, True, True]


def test_frequent_groups_are_never_broadcast_uncounted(spark):
    relation = P.first_relation(frame(spark, [("en", "a b c a b c")]))
    words, _ = P.frequent_words(relation, 1)
    assert {(r["word"], r["f"]) for r in words.collect()} == {("a", 2), ("b", 2), ("c", 2)} and sorted(r["id"] for r in words.collect()) == [0, 1, 2]
