import random
import re

import numpy as np

from semlattice.llm import neardup as N

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k, percent):
    """(n_shingles, component) by comparing all pairs."""
    ids = [d for d, _ in docs]
    sets = []
    for _, t in docs:
        w = W.findall((t or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(docs)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def family(prose, n, words, edits, seed):
    """Chained near copies of one text: a large group in which not all pairs are similar."""
    r = random.Random(seed)
    base = prose(words, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(make_docs, prose):
    texts = [prose(60, i) for i in range(20)] + family(prose, 60, 120, 9, 100) + family(prose, 30, 20, 2, 200) + ["a b", "A b", "a", "", None, prose(60, 3)]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    for spec in (N.NearDup(3, 85, 64), N.NearDup(5, 80, 96)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(make_docs(*docs), spec).collect()}
        assert got == brute(docs, spec.k, spec.percent)


def test_large_groups_in_blocks(make_docs, prose, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    docs = list(enumerate(family(prose, 80, 100, 8, 5)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(make_docs(*docs), N.NearDup(3, 85, 64)).collect()}
    assert got == brute(docs, 3, 85)


def test_all_pairs_within_the_distance_share_a_key():
    spec, r = N.NearDup(3, 85, 64), np.random.default_rng(1)
    assert len(spec.chunks) * 2 > spec.distance
    for _ in range(300):
        a = r.integers(0, 1 << 16, 64).astype(np.uint16)
        b = a.copy()
        b[r.choice(64, spec.distance, replace=False)] ^= 1
        assert set(spec.keys(a[None])[0].tolist()) & set(spec.keys(b[None])[0].tolist())


def test_edges(edge_docs, no_docs):
    got = N.near_duplicates(edge_docs, N.NearDup(3, 85, 64)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert len(got) == edge_docs.count()
    assert by[1] == [(1, True)] and by[2] == [(2, True)] and by[7] == [(6, False)] and by[4] == [(4, True)] * 2 and by[None] == [(None, True)]
    assert N.near_duplicates(no_docs).count() == 0
    kept = N.keep_one(edge_docs, N.NearDup(3, 85, 64))
    assert kept.columns == edge_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "8", "8", "9", "None"]
    assert N.keep_one(no_docs).count() == 0


def test_keep_one_decides_by_rows(spark, prose):
    """Null and repeated ids, equal rows with other columns: one rule for all."""
    a, b = prose(60, 1), prose(60, 2)
    rows = [(None, a, 1), (None, a, 2), (5, a, 3), (9, a + " tail", 4), (7, b, 5), (7, b, 6), (7, prose(60, 3), 7), (None, prose(60, 4), 8), (None, None, 9), (None, None, 10), (3, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nr int")
    for part in (docs, docs.where("nr <> 6")):
        kept = sorted(r["nr"] for r in N.keep_one(part).collect())
        assert [n for n in kept if n not in (5, 6)] == [3, 7, 8, 9, 10, 11] and len([n for n in kept if n in (5, 6)]) == 1
    two = docs.where("nr in (1, 2, 8)")
    assert len([r for r in N.keep_one(two).collect() if r["nr"] < 8]) == 1


def test_a_shared_key_alone_joins_no_group(make_docs, prose, monkeypatch):
    """Texts of middling likeness share keys by chance; groups hold those within the distance limit only."""
    base = prose(200, 1).split()
    docs = [(i, " ".join(base[:110] + prose(90, 10 + i).split())) for i in range(60)]
    spec = N.NearDup(3, 85, 64)
    prints = N.fingerprints(make_docs(*docs), spec)
    same = N.saved(prints.select(N.F.col("doc_id").alias("node"), "keys", "signature"))
    assert same.select("node", N.F.explode("keys").alias("k")).groupBy("k").count().where("count > 1").count() > 0
    assert N._coarse(same, spec).count() == 0
    monkeypatch.setattr(N, "KEY_ROWS", 4)
    near = list(enumerate(family(prose, 50, 100, 6, 9)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(make_docs(*near), spec).collect()}
    assert got == brute(near, 3, 85)
