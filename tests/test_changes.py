"""Components after changes, the view with reference counts, stored listings and bitmaps, against full computations."""

import os
import random

import pytest
from pyspark.sql import functions as F

from semlattice.operators import bitmaps as B
from semlattice.operators import components as C
from semlattice.operators import equivalence as E
from semlattice.operators import lifecycle as L
from semlattice.operators import pages as P
from semlattice.operators import view as V
from semlattice.plans.config import TRIPLES


def roots(edges):
    """Components of plain pairs."""
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return sorted((x, top(x)) for x in parent)


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "a string, b string")


@pytest.mark.parametrize("seed", [1, 2])
def test_canonical_after_random_changes(spark, rows, seed):
    r = random.Random(seed)
    node = lambda: f"n{r.randrange(30):02}"
    now = {(node(), node()) for _ in range(14)}
    current = E.canonical(frame(spark, now))
    for _ in range(3):
        later = {p for p in now if r.random() < 0.7} | {(node(), node()) for _ in range(r.randint(0, 5))}
        current = E.canonical_after(current, frame(spark, now), frame(spark, later))
        now = later
        assert rows(current) == roots(now)


def test_components_that_no_change_touches_stay(spark, rows):
    current = spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("z", "x")], "node string, root string")
    assert rows(C.with_edges(current, frame(spark, [("b", "m"), ("m", "m")]))) == [("a", "a"), ("b", "a"), ("m", "a"), ("x", "x"), ("y", "x"), ("z", "x")]
    assert rows(C.with_edges(current, frame(spark, [("b", "z"), ("0", "q")]))) == [("0", "0"), ("a", "a"), ("b", "a"), ("q", "0"), ("x", "a"), ("y", "a"), ("z", "a")]
    # the edges of a and b needn't even be there
    assert rows(C.without_edges(current, frame(spark, [("x", "y")]), frame(spark, [("y", "z")]))) == [("a", "a"), ("b", "a"), ("y", "y"), ("z", "y")]
    assert rows(C.with_edges(current, frame(spark, []))) == rows(current) == rows(C.without_edges(current, frame(spark, []), frame(spark, [])))


# ---- the view


def triples(spark, names):
    return spark.createDataFrame([(n, "p", f"o{i}", "literal", None if i else "integer", None) for n in names for i in range(2)], TRIPLES)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if "/counts/" in d and f.endswith(".parquet")}


def test_view_equals_the_lifecycle_graph(spark, rows, tmp_path):
    r = random.Random(9)
    v, stated = V.View(spark, f"file://{tmp_path}/v", buckets=4), {}
    assert v.graph().count() == 0 and v.compact() == []
    for step in range(8):
        source = f"upload_{r.randrange(3)}"
        if source in stated and r.random() < 0.4:
            v.withdraw(source)
            del stated[source]
        else:
            stated[source] = {f"s{r.randrange(9)}" for _ in range(r.randint(0, 5))}
            v.add(source, triples(spark, sorted(stated[source])).unionByName(triples(spark, sorted(stated[source])[:1])))
        if step % 3 == 2:
            v.compact()
        assert v.sources() == sorted(stated)
        want = [L.contribute(triples(spark, sorted(names)), s) for s, names in stated.items()]
        if want and step in (3, 7):
            whole = want[0]
            for w in want[1:]:
                whole = whole.unionByName(w)
            assert rows(v.graph()) == rows(L.graph(whole))
            assert {(x["s"], x["o"]): x["refs"] for x in v.references().collect()} == {(n, f"o{i}"): sum(n in names for names in stated.values()) for names in stated.values() for n in names for i in range(2)}


def test_compaction_rewrites_touched_buckets_only(spark, rows, tmp_path):
    v = V.View(spark, f"file://{tmp_path}/v", buckets=16)
    v.add("base", triples(spark, [f"s{i}" for i in range(200)]))
    assert len(v.compact()) == 16
    before = files(tmp_path)
    v.add("upload_x", triples(spark, ["s1", "new"]))
    touched = v.compact()
    assert 1 <= len(touched) <= 2
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items()) and {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == {str(b) for b in touched}
    v.withdraw("upload_x")
    assert v.compact() == touched and v.graph().count() == 400
    # the whole source goes again: its buckets are left without rows
    v.withdraw("base")
    assert len(v.compact()) == 16 and v.graph().count() == 0
    with pytest.raises(ValueError, match="not in the view"):
        v.withdraw("base")


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    v = V.View(spark, f"file://{tmp_path}/v", buckets=2)
    for _ in range(2):
        v.add("batch_1", triples(spark, ["a", "b"]))
    assert {r["refs"] for r in v.references().collect()} == {1}
    v.compact()
    for _ in range(2):
        v.add("batch_1", triples(spark, ["a", "b"]))
    assert {r["refs"] for r in v.references().collect()} == {1} and v.graph().count() == 4
    # a change without its manifest is none
    v._write(triples(spark, ["half"]), v._place("batch_2", 1))
    os.makedirs(f"{tmp_path}/v/manifests/000000000099")
    assert v.graph().count() == 4 and v.sources() == ["batch_1"]


# ---- listings


def test_pages_of_a_listing(spark):
    r = random.Random(2)
    data = [(i, r.randrange(40)) for i in range(1000)]
    index = P.listed(spark.createDataFrame(data, "id int, v int"), [F.col("v").desc(), F.col("id")], block=64)
    want = [i for i, _ in sorted(data, key=lambda x: (-x[1], x[0]))]
    for offset, limit in ((0, 10), (60, 10), (130, 200), (990, 20), (5000, 5)):
        got = P.opened(spark, index.path).page(limit, offset).collect()
        assert [x["id"] for x in got] == want[offset : offset + limit] and all(x["total"] == 1000 and x["has_more"] == (offset + limit < 1000) for x in got)
    assert len(index.page(10, 500).inputFiles()) > 0
    read = {f.split("block=")[1].split("/")[0] for f in index.page(10, 500).select("id").where("id >= 0").inputFiles()}
    plan = index.page(10, 500)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and read
    assert P.listed(spark.range(0), ["id"]).page(5).count() == 0
    with pytest.raises(ValueError, match="limit"):
        index.page(0)


# ---- bitmaps


def test_distinct_counts_over_any_sources(spark, rows):
    r = random.Random(3)
    data = [(r.choice("ab"), r.choice(["x", "y", "z"]), r.randrange(70_000)) for _ in range(3000)] + [("a", "x", 0), ("a", "y", 0), ("c", "x", 5), ("d", "x", None)]
    maps = B.bitmaps(spark.createDataFrame(data + data[:100], "k string, src string, id long"), ["k"], "src", "id")

    def want(sources):
        return sorted((k, len({i for kk, s, i in data if kk == k and s in sources and i is not None})) for k in "abcd" if any(kk == k and s in sources and i is not None for kk, s, i in data))

    assert rows(B.distinct_counts(maps, ["k"])) == want("xyz")
    assert rows(B.distinct_counts(maps, ["k"], ["x"])) == want("yz") and rows(B.distinct_counts(maps, ["k"], ["x", "z"])) == want("y")
    gone = {k: n for k, n in want("xyz")}
    assert rows(B.vanishing_counts(maps, ["k"], "x")) == sorted((k, n - dict(want("yz")).get(k, 0)) for k, n in gone.items() if n > dict(want("yz")).get(k, 0))
