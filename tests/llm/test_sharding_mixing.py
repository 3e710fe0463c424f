import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from semlattice.llm import mixing as X
from semlattice.llm import sharding as S


def jump(key, n):
    """The published loop, in whole numbers."""
    key = (-1 if key is None else key) % (1 << 64)
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = (b + 1) * (1 << 31) // ((key >> 33) + 1)
    return b


def test_jump(spark, make_docs):
    keys = [*range(300), -1, -5, 2**63 - 1, -(2**63), None]
    for n in (1, 2, 40):
        got = S.placed(make_docs(*[(k, "x") for k in keys]), n).collect()
        for r in got:
            assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], n), jump(r["doc_id"], n + 1))
            assert r["grown_shard"] in (r["shard"], n)


def test_slots_sizes_and_edges(edge_docs, no_docs):
    rows = S.placed(edge_docs, 3).collect()
    assert len(rows) == edge_docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = Counter((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in edge_docs.collect())
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert S.placed(no_docs, 3).count() == 0
    out = S.with_shards(edge_docs, 40)
    assert out.columns == edge_docs.columns and all(r["shard"] == jump(r["doc_id"], 40) for r in out.collect())


def test_targets():
    assert X.targets([100, 100, 100], X.Mix()) == [50.0, 100.0, 150.0]
    got = X.targets([1000, 1, 10], X.Mix())
    assert got[1:] == [3.0, 30.0] and math.isclose(sum(got), 1011)
    assert X.targets([0, 0], X.Mix()) == [0.0, 0.0] and X.targets([], X.Mix()) == []


def test_mix_meets_targets_and_repeats(make_docs, prose):
    docs = [(s * 1000 + i, prose(5 + (i * 37) % 60, s * 1000 + i), f"s{s}" if s < 4 else None) for s, n in enumerate((120, 40, 15, 200, 60)) for i in range(n)]
    spec = X.Mix(block_words=300, block_rows=30, shard_blocks=4)
    frame = make_docs(*docs)
    rows = X.taken_words(frame, spec).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in docs)
    taken, target = Counter(), {}
    for r in rows:
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        target[key] = r["target"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    assert len(target) == 5 and all(abs(taken[k] - target[k]) <= 0.02 * target[k] + 10 for k in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, X.taken_words(frame.repartition(7), spec).collect()))
    copies = Counter(r["doc_id"] for r in X.mixed(frame, spec).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_tree_keeps_quotas():
    tree = X.Tree([1000, 3, 0, 250], 13, 1)
    leaves = [tree.node(i, i + 1)[0] for i in range(13) if (i, i + 1) in _leaves(13)]
    assert sum(leaves).tolist() == [1000, 3, 0, 250]
    assert max(x.sum() for x in leaves) - min(x.sum() for x in leaves) <= 13
    placed = Counter((0, tree.place(0, r)) for r in range(1000))
    assert all(placed[0, i] == tree.node(i, i + 1)[0][0] for i in range(13))
    again = X.Tree([1000, 3, 0, 250], 13, 1)
    assert [again.place(3, r) for r in range(250)] == [tree.place(3, r) for r in range(250)]


def _leaves(n):
    return {(i, i + 1) for i in range(n)}


def test_mixing_edges(edge_docs, no_docs):
    rows = X.taken_words(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert X.taken_words(no_docs).count() == 0 and X.mixed(no_docs).count() == 0
    assert X.mixed(edge_docs).columns == edge_docs.columns


def test_repeated_rows_meet_targets(make_docs, prose):
    """A third of all rows, and most of a source, are one row."""
    docs = [(1, prose(30, 1), "a")] * 400 + [(10 + i, prose(25 + i % 11, 10 + i), "a") for i in range(50)] + [(1000 + i, prose(15, 1000 + i), "b") for i in range(250)] + [(5000 + i, prose(40, 5000 + i), "c") for i in range(300)]
    for seed in (1, 2, 3):
        spec = X.Mix(seed=seed, block_words=600, block_rows=40, shard_blocks=4)
        rows = X.taken_words(make_docs(*docs), spec).collect()
        assert len(rows) == len(docs)
        taken, target = Counter(), {}
        for r in rows:
            taken[r["source_size"]] += r["taken"]
            target[r["source_size"]] = r["target"]
            assert r["copies"] == len(r["shards"]) <= 3 and r["taken"] == r["copies"] * r["size"]
        assert all(abs(taken[k] - t) <= 20 for k, t in target.items()), (taken, target)
        mixed = Counter((r["doc_id"], r["source"]) for r in X.mixed(make_docs(*docs), spec).collect())
        want = Counter()
        for r in rows:
            want[r["doc_id"]] += r["copies"]
        assert mixed == Counter({(d, s): want[d] for d, _, s in docs if want[d]})


def test_steps_and_salts(make_docs, prose, monkeypatch):
    monkeypatch.setattr(X, "STEP", 3)
    monkeypatch.setattr(X, "SALT", 2)
    docs = [(1, prose(10, 1), "a")] * 90 + [(2, None, "a")] * 20 + [(3 + i, prose(12, i), "b") for i in range(60)]
    spec = X.Mix(block_words=50, block_rows=4, shard_blocks=2)
    rows = X.taken_words(make_docs(*docs), spec).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in X.mixed(make_docs(*docs), spec).collect()) == Counter({k: v for k, v in want.items() if v})


def test_one_text_in_two_sources(make_docs, prose):
    """Each source's draws are its own."""
    docs = [(1, prose(20, 1), "a"), (1, prose(20, 1), "b"), (2, prose(300, 2), "b"), (3, prose(300, 3), "c")]
    want = Counter({(r["doc_id"], r["source_size"]): r["copies"] for r in X.taken_words(make_docs(*docs)).collect() if r["copies"]})
    sizes = {"a": 20, "b": 320, "c": 300}
    got = Counter((r["doc_id"], sizes[r["source"]]) for r in X.mixed(make_docs(*docs)).collect())
    assert got == want and max(got.values()) <= 3 and got[1, 20] == 3


def test_other_columns_and_maps_come_along(spark, prose):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, prose(9, 1), "a", i % 2, {"k": i % 2}) for i in range(40)], "doc_id long, text string, source string, part int, m map<string,int>")
    got = X.mixed(docs.withColumn("row", F.col("part")))
    assert got.columns == ["doc_id", "text", "source", "part", "m", "row"] and Counter((r["part"], r["m"]["k"], r["row"]) for r in got.collect()) == {(0, 0, 0): 20, (1, 1, 1): 20}


def test_shards_hold_the_trees_leaves(make_docs, prose):
    """The draws of a shard that its rows show, counted by source, are the tree's leaf. Targets are whole rows, so no drawn block is empty."""
    docs = [(i, prose(10, i), f"s{i % 3}") for i in range(198)]
    spec = X.Mix(block_words=1, block_rows=1, shard_blocks=8)
    rows = X.taken_words(make_docs(*docs), spec).collect()
    known = X.units(X.keyed(make_docs(*docs), False).drop("row"))
    plan = X.source_plan(known, spec)
    parts = X._parts(known, make_docs().sparkSession.createDataFrame([(int(r), s, int(b)) for r, s, b in zip(plan["rank"], plan["source"], plan["blocks"])], "source_rank int, source string, blocks long"), spec)
    block = {r["doc_id"]: (r["source_rank"], r["block"]) for r in parts.collect()}
    drawn = {(block[r["doc_id"]], nr, s) for r in rows for nr, s in enumerate(r["shards"])}
    quotas = Counter(b[0] for b, _, _ in drawn)
    shards = -(-sum(quotas.values()) // spec.shard_blocks)
    tree = X.Tree([quotas[i] for i in range(3)], shards, spec.seed)
    leaves = Counter((b[0], s) for b, _, s in drawn)
    for i in range(shards):
        lo, hi = 0, shards
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if i < mid else (mid, hi)
        assert [leaves[s, i] for s in range(3)] == tree.node(i, i + 1)[0].tolist()


def test_large_populations():
    import numpy as np

    rng = np.random.default_rng(1)
    for good, bad, take in ((3 * 10**9, 10**9, 10**9), (10**12, 5, 10**12), (7, 10**11, 10**10)):
        x = X._hypergeometric(rng, good, bad, take)
        assert max(0, take - bad) <= x <= min(good, take) and abs(x - take * good / (good + bad)) <= 10 * (take * good / (good + bad)) ** 0.5 + 10


def test_large_draws_follow_the_exact_distribution():
    """The sampler for populations beyond 1e9, where the exact weights can still be added up."""
    rng = np.random.default_rng(5)
    for good, bad, take in ((7, 9, 6), (40, 25, 30), (3, 200, 90)):
        draws = [X.large_hypergeometric(rng, good, bad, take) for _ in range(1500)]
        weight = {k: math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take) for k in range(max(0, take - bad), min(good, take) + 1)}
        chi = sum((draws.count(k) - 1500 * w) ** 2 / (1500 * w) for k, w in weight.items() if 1500 * w >= 5)
        assert set(draws) <= weight.keys() and chi < 3 * len(weight) + 12
    good, bad, take = 3 * 10**12, 7 * 10**12, 10**6
    draws = [X.large_hypergeometric(rng, good, bad, take) for _ in range(200)]
    spread = (take * 0.3 * 0.7) ** 0.5
    assert abs(np.mean(draws) - 300_000) < 5 * spread / 200**0.5 and 0.75 < np.std(draws) / spread < 1.25
    assert X.large_hypergeometric(rng, 0, 10**12, 5) == 0 and X.large_hypergeometric(rng, 10**12, 0, 5) == 5
    assert abs(float(X._log_factorial(10**6)) - math.lgamma(10**6 + 1)) < 1e-6
