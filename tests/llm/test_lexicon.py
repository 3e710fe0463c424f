"""The lexicon against dictionaries, and the ids against the plain call of the library."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from semlattice.llm import lexicon as L

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*" \n\t\r\x0b\x0c\x1c\x85\xa0   　", " ", " ", "a", "Foo", "é", "ß", "×", *".,;:!?'-()|<>", "'s", "'re", "1", "23", "数", "か", "́", "🙂", "\x00", "<|endoftext|>", "aaaaaaaaaa", "the", " the", "x" * 60]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def automaton(words, ids=None):
    words = sorted(set(words))
    return L.Automaton(L.compiled(words, ids or [np.array([i, i + 1], np.uint32)[: i % 3] for i in range(len(words))]))


def look_up(a, words):
    sizes = np.array([len(w) for w in words], np.int64)
    return a.numbers(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=40), st.lists(st.binary(max_size=7).map(lambda b: bytes(x % 4 + 97 for x in b)), min_size=1, max_size=20))
def test_numbers_and_least_states(words, others):
    a, known = automaton(words), sorted(set(words))
    assert look_up(a, [*known, *others]) == [*range(len(known)), *[known.index(w) if w in known else -1 for w in others]]
    # as many states as there are different sets of endings
    endings = {frozenset(w[len(p):] for w in known if w.startswith(p)) for w in [*known, b""] for p in (w[:i] for i in range(len(w) + 1))}
    assert a.states == len(endings)


def test_endings_are_shared():
    a = automaton([x + y for x in (b"walk", b"talk", b"jump") for y in (b"", b"s", b"ed", b"ing")])
    assert a.words == 12 and a.states < 18
    with pytest.raises(ValueError, match="ascending"):
        L.compiled([b"b", b"a"], [np.zeros(0, np.uint32)] * 2)
    with pytest.raises(ValueError, match="lexicon"):
        L.Automaton(b"nothing of the kind and too short")


def lexicon_of(texts):
    """A lexicon of half of the texts' words."""
    words = sorted({w for w in L.cut(pa.array(texts, pa.string())).words.to_pylist()} | {b" the"})[::2]
    tables = L.merges(PATH)
    ids, n = tables.pieces([w.decode() for w in words])
    return L.Automaton(L.compiled(words, np.split(ids, np.cumsum(n)[:-1])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=12))
def test_ids_and_texts_are_the_librarys(plain, texts):
    tables = L.merges(PATH)
    ids, at = L.encode(pa.array(texts, pa.string()), tables, lexicon_of([t.replace("<|endoftext|>", "") for t in texts]))
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    listed, decoded = L.digests(ids, at, tables)
    assert listed == [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in got]
    assert decoded == [hashlib.sha256(plain.decode(i, skip_special_tokens=False).encode()).hexdigest() for i in got]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_characters(plain, text):
    ids, _ = L.encode(pa.array([text], pa.string()), L.merges(PATH), L.Automaton(L.compiled([], [])))
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_words(plain):
    texts = ["a" * 5000, "ab" * 300 + "é" * 200, "thethethe" * 40, "=" * 1000, "x" * 49, "x" * 48]
    assert [i for i in L.merges(PATH).merged(["".join(c for c, _ in L.merges(PATH).split(t)) for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_of_broken_characters(plain):
    """Ids that cut a character in two give replacement signs, as in the library."""
    ids = plain.encode("🙂数", add_special_tokens=False).ids
    for part in (ids[:1], ids[1:], ids[:-1]):
        _, decoded = L.digests(np.array(part, np.uint32), np.array([0, len(part)]), L.merges(PATH))
        assert decoded == [hashlib.sha256(plain.decode(part, skip_special_tokens=False).encode()).hexdigest()]


def want(plain, docs):
    out = []
    for d, t in docs:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [0, 3, 100_000])
def test_documents(plain, edge_docs, no_docs, rows, words):
    got = rows(L.coded(edge_docs, L.Lexicon(PATH, words=words, word_bytes=12)))
    assert got == want(plain, [(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert words or L.coded(no_docs, L.Lexicon(PATH)).count() == 0


def test_the_lexicon_holds_the_most_frequent_words(spark):
    counts = spark.createDataFrame([(b"a" * (i % 20 + 1), i) for i in range(1, 2000)], "word binary, n long")
    some = L.frequent(counts, L.Lexicon(PATH, words=500, word_bytes=15)).collect()
    assert 300 < len(some) <= 500 and min(r["n"] for r in some) > 1200 and max(len(r["word"]) for r in some) == 15
    assert L.frequent(counts, L.Lexicon(PATH, words=0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_query_gives_the_librarys_ids(spark, plain, rows):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows(L.op11_transducer_bpe(spark, "/root/testdata/sf0.001")) == want(plain, docs)
