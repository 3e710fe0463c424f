import random

import numpy as np
from pyspark.sql import functions as F

from semlattice.llm import decontam as D
from semlattice.llm import topk as K


def test_exact_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(24)]) for i in range(300)] + [(1000 + i, [0.5] * 24) for i in range(40)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 24), (2003, [1.0] * 3), (None, [1.0] * 24)]
    v = K.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    own = {x["vec_id"]: np.array(x["v"]) for x in v.collect()}
    assert len(own) == 341 and own[1000].tolist() == [512] * 24
    got = K.top_k(v.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), v, K.Search(k=7, row_block=50, query_block=6)).collect()
    want = []
    for q in own:
        if q % 20 == 0:
            best = sorted((-int(own[q] @ own[c]), c) for c in own if c != q and len(own[c]) == len(own[q]))[:7]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert K.top_k(v.where("false").withColumnRenamed("vec_id", "query_id"), v).count() == 0


def test_repeated_ids_are_one_candidate(spark):
    r = random.Random(5)
    rows = [(i, [r.randint(-9, 9) for _ in range(8)]) for i in range(60)]
    rows += [(200, [9] * 8)] * 12 + [(201, [8 + j % 2] * 8) for j in range(12)] + [(0, [1] * 8), (0, [1] * 8), (0, [-3] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = K.top_k(v.where("vec_id in (0, 1)").withColumnRenamed("vec_id", "query_id"), v, K.Search(row_block=16)).collect()
    want = []
    for q in (0, 1):
        score = {}
        for i, x in rows:
            for j, y in rows:
                if i == q and j != q:
                    score[j] = max(score.get(j, -(10**9)), sum(a * b for a, b in zip(x, y, strict=True)))
        want += [(q, n + 1, c, s) for n, (c, s) in enumerate(sorted(score.items(), key=lambda e: (-e[1], e[0]))[:10])]
    assert sorted(map(tuple, got)) == want


def test_segment_bounds_hold():
    r = np.random.default_rng(0)
    a, b = r.integers(-2000, 2000, (30, 64)), r.integers(-2000, 2000, (40, 64))
    exact, last = a @ b.T, None
    for n in (1, 4, 16, 64):
        bound = K.segment_statistics(a.astype(float), n) @ K.segment_statistics(b.astype(float), n).T
        assert (bound >= exact - 1e-3).all() and (last is None or bound.mean() <= last)
        last = bound.mean()


ITEM = "Yesterday morning Alice walked 12 miles to the old market and bought 7 red apples for her brother Tom"


def test_leaks(spark, make_docs, prose):
    bench = spark.createDataFrame([(1, ITEM), (2, "Too short"), (3, None), (4, prose(25, 9)), (None, ITEM)], "item_id long, text string")
    other = ITEM.replace("Alice", "Carol").replace("12", "30").replace("7", "5").replace("Tom", "Bob")
    twice = "Each of the 5 boxes in the cellar holds exactly 5 small green bottles of wine"
    bench = bench.unionByName(spark.createDataFrame([(5, twice)], "item_id long, text string"))
    docs = make_docs(
        (1, prose(80, 1)), (2, f"{prose(30, 2)} {ITEM} {prose(20, 3)}"), (3, f"{prose(30, 4)}. {other}. {prose(9, 5)}"), (4, " ".join(ITEM.split()[:9])),
        (5, prose(25, 9) + " tail"), (6, twice.replace("5", "8")), (7, twice.replace("5 boxes", "8 boxes")), (None, ITEM), (8, None), (9, ""), (2, prose(5, 8)),
    )
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in D.leaks(docs, bench).collect()}
    assert got == {(2, 1): False, (3, 1): True, (5, 4): False, (6, 5): True}
    # rows are decided by their own texts: the leaked one without a doc_id goes, the clean one of doc_id 2 stays
    left = D.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "4", "7", "8", "9"]
    assert D.leaks(docs, bench.where("false")).count() == 0 and D.leaks(docs.where("false"), bench).count() == 0


def test_columns_keep_their_values_whatever_their_names(spark, make_docs, prose):
    from semlattice.llm import neardup

    docs = make_docs((1, prose(80, 1)), (2, f"{prose(30, 2)} {ITEM} {prose(20, 3)}"), (3, prose(80, 1)))
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for left, ids in ((D.without_leaks(docs, bench), {1, 3}), (neardup.keep_one(docs), {1, 2})):
        assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == ids
        assert {(r["__row"], r["__text"], r["row_key"]) for r in left.collect()} == {(77, "own", "key")}


def test_a_later_instance_of_a_template_counts(spark, make_docs, prose):
    boxes = "Each of the 5 boxes in the cellar holds exactly 5 small green bottles of wine"
    bad, anew = boxes.replace("5 boxes", "3 boxes").replace("5 small", "4 small"), boxes.replace("5", "8")
    longer = boxes.replace("small green", "small and green")
    docs = make_docs(
        (1, f"{bad}. {prose(20, 1)} {boxes}."), (2, f"{bad}. {prose(20, 2)}. {anew}. {bad}."), (3, f"{bad}. {prose(9, 3)}. {bad}."),
        (4, f"{bad}. {bad}. {bad}. {longer}. {prose(5, 4)}"), (5, f"{anew}. {prose(9, 5)}. {bad}"),
    )
    bench = spark.createDataFrame([(1, boxes)], "item_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in D.leaks(docs, bench, D.Decontam(cover=0.5)).collect()}
    assert got == {1: False, 2: True, 4: False, 5: True}


def test_short_and_placeholder_items_are_held_with_their_values(spark, make_docs, prose):
    items = ["What is 12 + 7?", "1 2 3 4 5 6 7 8", "Alice met Bob, Carol, Dan and Tom", "小明有十二个苹果，他吃了三个，还剩几个苹果？", "Seldom"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make_docs(*[(i, f"{prose(9, i)} {t} {prose(9, 50 + i)}") for i, t in enumerate(items)], (10, "What is 12 + 9? " + prose(9, 7)), (11, "8 7 6 5 4 3 2 1"), (12, "小明有三本书"), (13, "What is 12 + 7"), (14, " seldom!"), (15, "seldom seldom"))
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(len(items) - 1)} | {(13, 0), (14, 4)}


def test_decontam_edges(spark, edge_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 3 4 5 6 7 8")], "item_id long, text string")
    assert D.leaks(edge_docs, bench).count() == 0
