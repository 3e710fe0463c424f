import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from semlattice.llm import chunks as C
from semlattice.llm import licences as L
from semlattice.llm import tokenfile as T

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPEC = T.Tokens(public_tokenizers.path("byte_bpe_50k.json"))


# ---- licences


def test_base_places_and_templates(make_docs, prose):
    mit = L.TEMPLATES[0][1]
    docs = [
        (1, "x UNDER the MIT, License! y; under-the.mit license"), (2, "Apache License, Version 2.0 and CC BY-NC"), (3, prose(50, 1) + " " + mit + " " + prose(9, 2)),
        (4, prose(50, 3)), (5, mit[:200] + " oops " + mit[204:]), (6, "This work is licensed under the GNU General Public License, version 3."), (7, "under the mit " * 5),
    ]
    got = {r["doc_id"]: r for r in L.licence_spans(make_docs(*docs)).collect()}
    for i, t in docs:
        w = W.findall(t.lower())
        places = [(k, label) for p, label in L.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places)) and (r["first_word"], r["last_word"]) == (min([k for k, _ in places], default=None), max([k for k, _ in places], default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[3]["labels"] == "mit" and got[3]["spans"][0]["first_word"] == 50 and got[5]["labels"] == "mit" and got[6]["labels"] == "gpl-3"
    assert got[4]["labels"] == "" and got[4]["score"] < 0.3 and got[7]["n_base"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=25))
def test_matching_statistics(texts, stream):
    a = L.Automaton()
    for text in texts:
        state = 0
        for token in text:
            state = a.extend(state, token)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
    for i, (_, n) in enumerate(a.statistics(stream)):
        assert n == max(k for k in range(i + 2) if tuple(stream[i + 1 - k : i + 1]) in runs)


def test_licence_edges(edge_docs, no_docs):
    rows = L.licence_spans(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r["labels"] == "" and r["n_base"] == 0 for r in rows)
    assert L.licence_spans(no_docs).count() == 0


def test_common_words_give_no_label(make_docs):
    texts = {
        "Licensed under the BSD license": "", "released under the name of its author": "", "licensed under the": "", "Licensed under CC BY SA 4.0": "",
        "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License": "",
        "Released under the MIT.": "mit", "licensed under the MIT license": "mit", "Licensed under CC BY 4.0": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        **{t: label for label, t in L.TEMPLATES if len(t.split()) >= 10},
    }
    got = {r["doc_id"]: r["labels"] for r in L.licence_spans(make_docs(*enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


# ---- chunks


def test_repeats_are_found_and_clean_texts_left_alone(make_docs, prose):
    shared = prose(60, 999)
    docs = [(i, prose(200, i)) for i in range(30)] + [(100 + i, f"{prose(20 + 7 * i, 500 + i)} {shared} {prose(30, 700 + i)}") for i in range(5)] + [(200, prose(5, 1000) + " " + "again and again " * 30)]
    rows = C.repeated_spans(make_docs(*docs)).collect()
    assert {r["doc_id"] for r in rows} == {100, 101, 102, 103, 104}
    text = dict(docs)
    for r in rows:
        part = " ".join(text[r["doc_id"]].split()[r["first_word"] : r["end_word"]])
        assert part in shared and r["first_doc"] == 100 and r["is_first"] == (r["doc_id"] == 100) and r["n_words"] >= 20


def test_repeating_passages_and_capitals(make_docs, prose):
    passages = [" ".join((prose(w, 40 + 10 * w + j).split() * 80)[:80]) for w in (1, 2, 3, 5, 8) for j in range(4)]
    docs = [d for i, p in enumerate(passages) for d in ((i, f"{prose(25, 2000 + i)} {p} {prose(25, 3000 + i)}"), (100 + i, f"{prose(31, 4000 + i)} {p.upper() if i % 2 else p} {prose(20, 5000 + i)}"))]
    got = {(r["doc_id"], r["first_doc"]) for r in C.repeated_spans(make_docs(*docs)).collect()}
    assert {(i + d, i) for i in range(len(passages)) for d in (0, 100)} <= got


def test_chunk_edges(edge_docs, no_docs):
    rows = C.repeated_spans(edge_docs).collect()
    assert [(r["doc_id"], r["first_word"], r["end_word"], r["first_doc"]) for r in sorted(rows)] == [(6, 0, 30_000, 6), (7, 0, 30_000, 6)]
    assert C.repeated_spans(no_docs).count() == 0


# ---- token files


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 50_256), st.integers(0, 2**32 - 1)), max_size=3000))
def test_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (T.unpack(*T.pack(ids), len(ids)) == ids).all()


def test_packing_holds_sixty_small_ids_in_a_word():
    assert len(T.pack(np.zeros(120, np.uint32))[0]) == 2 and len(T.pack(np.full(8, 16_000, np.uint32))[0]) == 2
    assert T.pack(np.zeros(0, np.uint32))[0].size == 0


PARTS = [*" \n\t\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u3000", " ", " ", "\n", "a", "Foo", "é", "ß", "×", "÷", "ſ", *".,;:!?'-()|<>", "'s", "'re", "1", "23", "数", "か", "\u0301", "🙂", "\x00", "<|endoftext|>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=20), st.booleans(), st.booleans())
def test_pieces_give_the_tokenizers_ids(texts, added, forgetful):
    import pyarrow as pa

    plain = Tokenizer.from_file(SPEC.tokenizer)
    plain.encode_special_tokens = not added
    encoder, kept = T.Encoder.of(SPEC.tokenizer, added), T.MEMO
    T.MEMO = 30 if forgetful else kept
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    T.MEMO = kept
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_query_gives_the_plain_calls_ids(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    plain, want, start = Tokenizer.from_file(SPEC.tokenizer), [], 0
    for doc_id, text in docs:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, T.op6_simple8b_token_files(spark, "/root/testdata/sf0.001").collect())) == want


def test_added_tokens_get_their_ids():
    import pyarrow as pa

    t = Tokenizer.from_file(SPEC.tokenizer)
    texts = ["a<|endoftext|>b", "x y  <|endoftext|>  z", "<|endoftext|>", "<|endoftext| > a b", "plain words here", ""]
    ids, at = T.Encoder.of(SPEC.tokenizer, added=True).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert ids[: at[1]].tolist() == [64, 50256, 65]


def test_the_query_takes_added_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = T.op6_simple8b_token_files(spark, str(tmp_path)).collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(4, zlib.crc32(np.array([64, 50256, 65, 2], "<u4").tobytes()))]


def test_files(edge_docs, no_docs, rows):
    from semlattice.llm.common import saved

    t = Tokenizer.from_file(SPEC.tokenizer)
    t.encode_special_tokens = True
    got = T.read_tokens(saved(T.token_files(edge_docs, T.Tokens(SPEC.tokenizer, file_bytes=100)))).collect()
    want = {}
    for d in edge_docs.collect():
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        want.setdefault(d["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in have.items()}
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert T.read_tokens(saved(T.token_files(no_docs, SPEC))).count() == 0
