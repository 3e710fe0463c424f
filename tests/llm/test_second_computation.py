"""Results that SQL can't express, computed a second time in plain Python."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from semlattice.llm import bytewords as bw
from semlattice.llm import chunks as C
from semlattice.llm import licences as L
from semlattice.llm import mixing as X
from semlattice.llm import quality as Q
from semlattice.llm import toxicity as T

NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def mix(x):
    return int(bw.mix(np.array([x & MASK], np.uint64))[0])


# ---- toxicity


def plain_features(text, bits=20):
    words = [lower(w) for w in NON_SPACE.findall(text)]
    h, out = [bw.word_hash(w) for w in words], set()
    for w, x in zip(words, h):
        out.add(x >> (64 - bits))
        for size, salt in ((4, 0x51ED270B), (5, 0x2545F491)):
            if len(w.encode()) > size:
                out.add(mix(int(next(bw.slices(_binary(w.encode()[:size]), np.ones(256, bool))).hashes()[0]) + salt) >> (64 - bits))
    for gap, salt in ((1, 0x9E3779B1), (2, 0x85EBCA6B)):
        out |= {mix(a * 0xC2B2AE3D27D4EB4F + b + salt) >> (64 - bits) for a, b in zip(h, h[gap:])}
    return out


def _binary(raw):
    """Bytes that may end within a character, as a column."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int32)), pa.py_buffer(raw)])


TEXTS = ["Some Idiot wrote this, über den Fluß", "", "one", "a b a b a b", "x\ty\n zürich zürich", "long words everywhere, longer than four"]


def test_toxicity_scores(make_docs):
    seen = sorted(set().union(*map(plain_features, TEXTS)))
    r = random.Random(4)
    weights = {p: r.uniform(-1, 1) for p in seen if r.random() < 0.7}
    place = np.array([*weights, 1 << 20])
    value = np.array([*weights.values(), -0.3])
    got = {x["doc_id"]: x for x in T.scores(make_docs(*enumerate(TEXTS), (99, None)), (place, value)).collect()}
    for i, text in [*enumerate(TEXTS), (99, "")]:
        want = 1 / (1 + math.exp(-(sum(weights.get(p, 0) for p in plain_features(text)) - 0.3)))
        assert abs(got[i]["score"] - want) < 1e-5 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_ftrl_steps():
    """The published update, coordinate by coordinate."""
    r, spec = random.Random(2), T.Ftrl(bits=6, l1=0.2, least_texts=2, epochs=3)
    rows = [(np.array(sorted(r.sample(range(64), 9)), np.int32), r.randrange(2)) for _ in range(40)]
    counts = Counter(int(p) for at, _ in rows for p in at)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= spec.l1 else -(z[i] - math.copysign(spec.l1, z[i])) / ((spec.beta + math.sqrt(n[i])) / spec.alpha + spec.l2)

    for epoch in range(spec.epochs):
        for k in np.random.default_rng([17, epoch]).permutation(len(rows)):
            at = [int(p) for p in rows[k][0] if counts[int(p)] >= 2] + [64]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][1]
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / spec.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    place, value = T.train(rows, spec)
    want = {i: weight(i) for i in range(65) if weight(i)}
    assert place.tolist() == sorted(want) and np.allclose(value, [want[i] for i in sorted(want)])


# ---- quality


def plain_passages(text):
    raw = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out = []
    for i in range(0, len(words), Q.PASSAGE):
        part = words[i : i + Q.PASSAGE]
        end = words[i + Q.PASSAGE][0] if i + Q.PASSAGE < len(words) else len(raw)
        span = raw[part[0][0] : end]
        shares = [sum(Q.CLASS_OF[b] == c for b in span) / len(span) for c in range(Q.N_CLASSES)]
        length = [b - a for a, b in part]
        h = [bw.word_hash(lower(raw[a:b].decode())) for a, b in part]
        before = bw.word_hash(lower(raw[words[i - 1][0] : words[i - 1][1]].decode())) if i else None
        again = sum(x == y for x, y in zip(h, [before, *h]))
        signs = [sum(1 if x >> k & 1 else -1 for x in h) / math.sqrt(len(h)) for k in range(Q.PROJECTIONS)]
        out.append([*shares, math.log1p(len(part)), np.mean(length) / 10, np.std(length) / 10, len(set(h)) / len(h), again / len(h), *signs])
    return out


def test_quality_scores(make_docs, prose):
    texts = [prose(200, 1), "Ünï cödé 123 $$$ " * 30, "", "one", prose(64, 2), "  same same\tsame\n" * 50]
    x = np.array([p for t in texts for p in plain_passages(t)])
    model = Q.Model.new(x, Q.Mil())
    p = model.p
    p["b"][0] = 0.4
    got = {r["doc_id"]: r["score"] for r in Q.scores(make_docs(*enumerate(texts)), model).collect()}
    for i, text in enumerate(texts):
        bag = []
        for f in plain_passages(text):
            e = np.tanh(np.clip((np.array(f, np.float32) - p["mean"]) / p["scale"], -8, 8) @ p["W"] + p["b1"])
            gate = np.tanh(e @ p["V"]) / (1 + np.exp(-(e @ p["U"])))
            bag.append((math.exp(gate @ p["w"]), e))
        z = sum(a * e for a, e in bag) / sum(a for a, _ in bag) if bag else np.zeros(len(p["c"]))
        assert abs(got[i] - 1 / (1 + math.exp(-(z @ p["c"] + 0.4)))) < 1e-4


# ---- licences


def plain_scan(text, spec=L.Scan()):
    """Labels, spans and score by substring search, one template after the other."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    templates = [(label, t.split()) for label, t in spec.templates]
    phrases = [(label, p.split()) for p, label in spec.phrases]
    everything = [t for _, t in templates] + [p for _, p in phrases]
    runs = {tuple(t[i:j]) for t in everything for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    known = {w for t in everything for w in t}
    base = [(i, label) for i in range(len(words)) for label, p in phrases if words[i : i + len(p)] == p]
    matches = []
    for i in range(len(words)):
        # longest run from here that no longer run from an earlier word takes in
        j = i
        while j < len(words) and words[j] in known and tuple(words[i : j + 1]) in runs:
            j += 1
        if j - i >= spec.min_match and not (matches and matches[-1][1] >= j):
            matches.append((i, j))
    spans = []
    for nr, (label, t) in enumerate(templates):
        live = None
        for i, j in matches:
            run, n = words[i:j], j - i
            labels = {lab for lab, u in templates if any(u[k : k + n] == run for k in range(len(u)))}
            own = len(labels) == 1 or n == len(t)
            for place in sorted(k + n - 1 for k in range(len(t)) if t[k : k + n] == run):
                if live and place > live[2] and i - live[1] <= spec.gap and place - n - live[2] <= spec.gap:
                    fresh = min(n, place - live[2], j - live[1])
                    if fresh > 0:
                        live = [live[0], j, place, live[3] + fresh, live[4] or own]
                elif not live or i - live[1] > spec.gap or n > live[3]:
                    if live:
                        spans.append((nr, *live))
                    live = [i, j, place, n, own]
        if live:
            spans.append((nr, *live))
    good = [s for s in spans if s[5] and s[4] / len(templates[s[0]][1]) >= (spec.cover if len(templates[s[0]][1]) >= spec.short else spec.short_cover)]
    score = 1.0 if base else min(1.0, max((s[4] / len(templates[s[0]][1]) for s in spans), default=0.0))
    return sorted({label for _, label in base} | {templates[s[0]][0] for s in good}), sorted((s[0], s[1], s[2], s[4]) for s in good), score


def test_licence_labels_spans_and_scores(make_docs, prose):
    r = random.Random(8)
    pool = [t for _, t in L.TEMPLATES] + list(L.PHRASES)
    texts = []
    for i in range(90):
        words = prose(r.randint(0, 30), i).split()
        for _ in range(r.randint(0, 3)):
            t = r.choice(pool).split()
            a = r.randrange(len(t)) if r.random() < 0.3 else 0
            piece = t[a : a + r.randint(2, len(t))]
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(piece))
                piece[k : k + 1] = r.choice([[], ["oops"], [piece[k], "oops"]])
                piece = piece or ["x"]
            words += piece + prose(r.randint(0, 12), 100 + i).split()
        texts.append(" ".join(words).upper() if i % 7 == 0 else " ".join(words))
    got = {x["doc_id"]: x for x in L.licence_spans(make_docs(*enumerate(texts))).collect()}
    some = 0
    for i, text in enumerate(texts):
        labels, spans, score = plain_scan(text)
        some += bool(spans)
        assert got[i]["labels"] == ",".join(labels), (text, got[i], labels, spans)
        assert sorted((s["template"], s["first_word"], s["end_word"], s["covered"]) for s in got[i]["spans"]) == spans
        assert abs(got[i]["score"] - score) < 1e-9
    assert some > 15


# ---- substring deduplication


def plain_units(text, spec):
    """(digest, first word, end word) of a text; a digest is the unit's folded bytes and its number of chunks."""
    raw = (text or "").encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    table = [int(x) for x in C._GEAR]
    hashes = [sum(table[raw[e - 1 - k]] << k for k in range(min(spec.window, e))) % (1 << spec.window) for _, e in words]
    chunks, first = [], 0
    for i, h in enumerate(hashes):
        near = hashes[max(0, i - spec.near) : i + spec.near + 1]
        if h < (1 << spec.window) // spec.mean_words or h == min(near) or i == len(words) - 1:
            chunks.append((first, i + 1))
            first = i + 1
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    out = []
    for i in range(len(chunks)):
        if i + spec.unit <= len(chunks) or i == 0:
            part = chunks[i : i + spec.unit]
            out.append(((fold[words[part[0][0]][0] : words[part[-1][1] - 1][1]], len(part)), part[0][0], part[-1][1]))
    return out


@pytest.mark.parametrize("spec", [C.Chunking(min_words=8), C.Chunking(mean_words=6, unit=2, min_words=5, near=2, window=32)])
def test_substring_spans(make_docs, prose, spec):
    r = random.Random(3)
    passages = [prose(40, 1), prose(25, 2), "tick tock " * 30, "MIXED case Words " + prose(20, 3), "grüße  aus\nköln " * 6]
    docs = []
    for i in range(40):
        parts = [prose(r.randint(0, 25), 50 + i)]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            parts += [p.upper() if r.random() < 0.2 else p, prose(r.randint(0, 9), 500 + 7 * i)]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (0, docs[3][1]), (102, docs[4][1]), (102, docs[4][1])]
    where = defaultdict(set)
    rows = [(d, t, u) for d, t in docs for u in plain_units(t, spec)]
    for d, _, (digest, _, _) in rows:
        where[digest].add(d)
    found = defaultdict(set)
    for d, t, (digest, a, b) in rows:
        if len(where[digest]) > 1:
            found[d, t].add((a, b, min(where[digest])))
    want = set()
    for (d, _), spans in found.items():
        island = None
        for a, b, least in sorted(spans):
            if island and a < island[1]:
                island = [island[0], max(island[1], b), min(island[2], least)]
            else:
                if island and island[1] - island[0] >= spec.min_words:
                    want.add((d, *island))
                island = [a, b, least]
        if island[1] - island[0] >= spec.min_words:
            want.add((d, *island))
    got = {(x["doc_id"], x["first_word"], x["end_word"], x["first_doc"]) for x in C.repeated_spans(make_docs(*docs), spec).collect()}
    assert got == want and len(want) > 20


def test_spans_against_all_common_substrings(make_docs, prose):
    """Every span is a run that another document has too, and passages of 32 words or more are found nearly always."""
    lengths = [n for n in range(10, 60) for _ in range(4)]
    docs = []
    for i, n in enumerate(lengths):
        passage = prose(n, 10_000 + i)
        docs += [(2 * i + j, f"{prose(5 + i % 17, 20_000 + 2 * i + j)} {passage} {prose(3 + i % 11, 30_000 + 2 * i + j)}") for j in (0, 1)]
    words = {d: t.split() for d, t in docs}
    k = C.Chunking().min_words
    where = defaultdict(set)  # all runs of min_words words of all documents
    for d, w in words.items():
        for a in range(len(w) - k + 1):
            where[tuple(w[a : a + k])].add(d)
    longest = {}
    for i in range(len(lengths)):
        w = words[2 * i]
        shared = [len(where[tuple(w[a : a + k])]) > 1 for a in range(len(w) - k + 1)]
        runs = "".join("x" if s else " " for s in shared).split()
        longest[i] = max((len(x) + k - 1 for x in runs), default=0)
    rows = C.repeated_spans(make_docs(*docs)).collect()
    for r in rows:
        part = words[r["doc_id"]][r["first_word"] : r["end_word"]]
        assert len(part) >= k and all(len(where[tuple(part[a : a + k])]) > 1 for a in range(len(part) - k + 1))
    found = {r["doc_id"] // 2 for r in rows}
    assert found <= {i for i, n in longest.items() if n >= k}
    for least, share in ((32, 0.9), (40, 0.98)):
        long = {i for i, n in longest.items() if n >= least}
        assert len(found & long) >= share * len(long) > 50


# ---- mixing


def chained(*values):
    """Spark's xxhash64 of int (4 bytes), long and text columns; nulls are passed over."""
    seed = 42
    for kind, v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<" + kind, v), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_mix(docs, spec):
    """Words that the mix takes of each row: blocks, rounds and the boundary block, one after the other."""
    sizes = [(d, t or "", s, len(NON_SPACE.findall(t or ""))) for d, t, s in docs]
    names = sorted({s for *_, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for *_, x, n in sizes if x == s) for s in names}
    target = dict(zip(names, X.targets([total[s] for s in names], spec)))
    taken = {}
    for rank, s in enumerate(names):
        units = Counter((d, t, n) for d, t, x, n in sizes if x == s)
        blocks_n = max(1, math.ceil(total[s] / spec.block_words), math.ceil(sum(units.values()) / spec.block_rows))
        rounds = min(spec.cap, int((target[s] / total[s] if total[s] else 0) + 1e-9))
        rest = max(0.0, target[s] - rounds * total[s])
        blocks = defaultdict(list)
        for (d, t, n), many in units.items():
            if not n:
                taken[d, t, s] = Counter({0: many})
                continue
            each = max(1, min(spec.block_rows, spec.block_words // n))
            uid = chained(("i", 1), ("q", d), ("s", t))
            vid = chained(("i", 2), ("q", d), ("s", t))
            for part in range(math.ceil(many / each)):
                block = chained(("i", spec.seed), ("q", d), ("q", uid), ("q", part)) % blocks_n
                blocks[block].append((chained(("i", spec.seed + 2), ("q", d), ("q", uid), ("q", part)), d, uid, vid, part, t, n, min(each, many - part * each)))
        before = 0
        for block in sorted(blocks, key=lambda b: (chained(("i", spec.seed), ("i", rounds), ("i", rank), ("q", b)) % (1 << 64), b)):
            words = sum(p[6] * p[7] for p in blocks[block])
            more = [0] * len(blocks[block])
            if before < rest:
                if before + words <= rest:
                    more = [p[7] for p in blocks[block]]
                else:
                    room, order = rest - before, sorted(range(len(more)), key=lambda i: blocks[block][i][:5])
                    for i in order:
                        more[i] = int(min(blocks[block][i][7], room // blocks[block][i][6]))
                        room -= more[i] * blocks[block][i][6]
                    off = [(abs(room - blocks[block][i][6]), k, i) for k, i in enumerate(order) if more[i] < blocks[block][i][7]]
                    if off and min(off)[0] < room:
                        more[min(off)[2]] += 1
            for p, extra in zip(blocks[block], more):
                one = taken.setdefault((p[1], p[5], s), Counter())
                one[(rounds + 1) * p[6]] += extra
                one[rounds * p[6]] += p[7] - extra
            before += words
    return taken, target


@pytest.mark.parametrize("seed", [1, 7])
def test_mixing_takes(make_docs, prose, seed):
    docs = [(i, prose(3 + (i * 31) % 40, i), f"s{i % 4}" if i % 9 else None) for i in range(260)] + [(1000, prose(12, 5), "s1")] * 150 + [(2000, prose(900, 6), "s2"), (2001, None, "s3"), (2002, "", None), (2003, "x", "zz")]
    spec = X.Mix(seed=seed, block_words=250, block_rows=30, shard_blocks=4)
    taken, target = plain_mix(docs, spec)
    got = defaultdict(Counter)
    texts = {d: t or "" for d, t, _ in docs}
    sources = {d: s for d, _, s in docs}
    for r in X.taken_words(make_docs(*docs), spec).collect():
        got[r["doc_id"], texts[r["doc_id"]], sources[r["doc_id"]]][r["taken"]] += 1
        assert abs(r["target"] - target[sources[r["doc_id"]]]) < 1e-6
    assert dict(got) == {k: +v for k, v in taken.items()}


# ---- the pipeline


def plain_pipeline(docs, labels, items, weights):
    """Rows (doc_id, shard) of the five stages, each in plain Python. docs: (doc_id, text, source) of lower-case words."""
    from test_neardup import brute
    from test_sharding_mixing import jump

    by_place = dict(zip(weights[0].tolist(), weights[1].tolist()))
    bias = by_place.get(1 << 20, 0.0)
    docs = [d for d in docs if sum(by_place.get(p, 0) for p in plain_features(d[1])) + bias < 0]
    groups = brute([(d, t) for d, t, _ in docs], 5, 80)
    docs = [d for d in docs if not d[1].split() or groups[d[0]][1] == d[0]]
    windows = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    docs = [d for d in docs if not any(len(windows(i) & windows(d[1])) >= 0.8 * len(windows(i)) for i in items)]
    taken, _ = plain_mix(docs, X.Mix())
    return Counter({(d, jump(d, 40)): sum(n for n in [k // max(1, len(t.split())) * v for k, v in taken[d, t, s].items()]) for d, t, s in docs})


def test_pipeline_equals_plain_stages(spark, tmp_path, prose):
    import corpus_pipeline as P

    r, docs, labels = random.Random(6), [], []
    items = [prose(20, 900), prose(18, 901)]
    for i in range(260):
        words = prose(r.randint(8, 60), 3000 + i).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "vermin", "scumbag"]))
        docs.append((i, " ".join(words), f"s{i % 3}" if i % 7 else None))
        labels.append((i, int(toxic)))
    near = prose(80, 950).split()
    docs += [(300, " ".join(near), "s1"), (301, " ".join([*near, "more"]), "s1"), (302, " ".join(near), "s2"), (303, f"{prose(20, 5)} {items[0]} {prose(20, 7)}", "s0"), (304, items[1], None), (305, "", "s2")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' as lang", "source", "1L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    weights = T.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = plain_pipeline(docs, labels, items, weights)
    got = Counter((x["doc_id"], x["shard"]) for x in P.run(spark, str(tmp_path)).collect())
    assert got == +want and len(got) > 150 and max(got.values()) <= 3
    kept = {d for d, _ in got}
    assert not kept & {301, 302, 303, 304, 305}
