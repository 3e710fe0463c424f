import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from semlattice.llm import quality as Q
from semlattice.llm import toxicity as T

BAD = ["idiot", "vermin", "scumbag"]


@pytest.fixture(scope="module")
def corpus(spark, make_docs, prose):
    r = random.Random(1)
    docs, toxic, quality = [], [], []
    for i in range(600):
        words = prose(r.randint(30, 120), 5000 + i).split()
        t, q = int(i % 5 == 0), int(i % 4 != 1)
        if t:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        text = " ".join(words) if q else " ".join(w + r.choice(["$$$", "###", "&&&"]) for w in words)
        docs.append((i, text))
        toxic.append(t)
        quality.append(q)
    labels = spark.createDataFrame([(i, quality[i], toxic[i]) for i in range(600)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return make_docs(*docs), labels, toxic, quality


@pytest.mark.parametrize("m, truth, least", [(T, 2, 0.95), (Q, 3, 0.97)])
def test_held_out_accuracy(corpus, m, truth, least):
    docs, labels = corpus[:2]
    rows = m.scores(docs, m.fit(docs, labels)).collect()
    assert len(rows) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 80 and np.mean([r["predicted"] == corpus[truth][r["doc_id"]] for r in held]) >= least


def test_held_out_labels_are_not_used(corpus, spark):
    docs, labels = corpus[:2]
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for a, b in zip(T.fit(docs, labels), T.fit(docs, turned), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize("m", [T, Q])
def test_classifier_edges(m, corpus, edge_docs, no_docs):
    docs, labels = corpus[:2]
    model = m.fit(docs, labels)
    rows = m.scores(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert m.scores(no_docs, model).count() == 0
    untaught = m.fit(no_docs, labels.where("false"))
    assert m.scores(edge_docs, untaught).count() == edge_docs.count()


def test_toxic_rows_go_whatever_their_id(corpus, spark, prose):
    docs, labels = corpus[:2]
    bad, columns = " ".join(BAD * 3), ["doc_id", "text", "source", "extra"]
    rows = [(None, f"{prose(30, 1)} {bad}", "a", 1), (None, prose(30, 2), "a", 2), (7, f"{bad} {prose(30, 3)}", None, 3), (7, prose(30, 4), None, 4), (8, None, None, 5)]
    kept = T.without_toxic(spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").unionByName(docs.select("doc_id", "text", "source", "n_chars").toDF(*columns).withColumn("extra", F.lit(0))), labels)
    assert kept.columns == columns and sorted(r["extra"] for r in kept.where("extra > 0").collect()) == [2, 4, 5]
    scored = {r["doc_id"]: r["predicted"] for r in T.scores(docs, T.fit(docs, labels)).collect()}
    assert {r["doc_id"] for r in kept.where("extra = 0").collect()} == {d for d, p in scored.items() if not p}


def test_a_repeated_id_is_learnt_from_once(corpus, spark):
    docs, labels = corpus[:2]
    again = docs.unionByName(docs.where("doc_id % 3 = 0"))
    for a, b in zip(T.fit(docs, labels), T.fit(again, labels), strict=True):
        assert (a == b).all()
    one, two = Q.fit(docs, labels), Q.fit(again, labels)
    assert all(np.allclose(one.p[k], two.p[k], rtol=0.02, atol=0.02) for k in ("mean", "scale"))


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    x, counts, y = r.normal(size=(9, Q.N_FEATURES)), np.array([4, 1, 4]), np.array([1.0, 0.0, 1.0])
    heads = np.cumsum(counts) - counts
    model = Q.Model.new(x, Q.Mil())

    def loss():
        logits = model.forward(x, heads, counts)[0]
        return np.sum(np.logaddexp(0, logits) - y * logits)

    logits, kept = model.forward(x, heads, counts)
    grads = model.gradients(kept, heads, counts, Q._sigmoid(logits) - y)
    for k, g in grads.items():
        p = model.p[k]
        at = tuple(0 for _ in p.shape)
        was = p[at]
        p[at] = was + 1e-6
        up = loss()
        p[at] = was - 1e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-4
        p[at] = was


def test_pipeline(spark, tmp_path, corpus, edge_docs, prose):
    import corpus_pipeline as P

    docs, labels, toxic, _ = corpus
    item = "Of all the rivers in the north the longest one runs past seven old towns before it meets the sea"
    extra = [(1000, prose(90, 1)), (1001, prose(90, 1) + " more"), (1002, f"{prose(40, 2)} {item} {prose(40, 3)}"), (1003, prose(90, 4))]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    more = spark.createDataFrame([(i, t, "en", "z", 1) for i, t in extra], docs.select(columns).schema)
    docs.select(columns).unionByName(more).unionByName(edge_docs.select(columns)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        out = stage(spark, current, str(tmp_path))
        assert out.columns == (columns if name != "sharding" else [*columns, "shard"])
        out.write.parquet(str(tmp_path / f"out_{name}"))
        current = spark.read.parquet(str(tmp_path / f"out_{name}"))
        kept[name] = {r["doc_id"] for r in current.select("doc_id").collect()}
    assert sum(toxic[i] for i in kept["toxicity"] if i is not None and i < 600) <= 6
    assert len([i for i in range(600) if not toxic[i] and i not in kept["toxicity"]]) <= 6
    assert kept["near_dedup"] & {1000, 1001} == {1000} and {1002, 1003} <= kept["near_dedup"]
    assert kept["near_dedup"] - kept["decontamination"] == {1002}
    assert current.where("shard < 0 or shard > 39 or shard is null").count() == 0
    assert P.run(spark, str(tmp_path)).count() == current.count()
