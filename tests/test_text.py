from urllib.parse import quote

from pyspark.sql import functions as F

from semlattice.functions import text as X


def _one(spark, kind, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v")).alias("o")).collect()]


def test_slug_is_percent_encoding(spark):
    values = ["a b", "清华大学", "x/y?z", "~a*b+c", "  trim　", "é'()!", "100%"]
    assert _one(spark, "string", values, X.slug) == [quote(v.strip(), safe="") for v in values]
    assert _one(spark, "string", values, lambda c: X.unslug(X.slug(c))) == [v.strip() for v in values]


def test_numbers(spark):
    assert _one(spark, "string", ["-3.9", " 12 ", "x", "1.0d", "nan", "1e30", None, ""], X.integer_form) == ["-3", "12", None, None, None, None, None, None]
    assert _one(spark, "string", ["100", "1e5", "12.50", "2.0d", None, "10000000000"], X.decimal_form) == ["100.0", "100000.0", "12.5", None, None, "10000000000.0"]
    assert _one(spark, "string", ["-0.0", "-0", "0.0", " -0e3", "1e-11", "0.1234567890123", "-2.50"], X.decimal_form) == ["-0.0", "-0.0", "0.0", "-0.0", "1.0E-11", "0.1234567890123", "-2.5"]


def test_as_list(spark):
    f = lambda c: X.as_list(c, "string")
    assert _one(spark, "string", [None, "", "a; b ;;c", '["x"," ","y"]', "[bad", "one"], f) == [[], [], ["a", "b", "c"], ["x", "y"], ["[bad"], ["one"]]
    assert _one(spark, "string", ["a;b"], lambda c: X.as_list(c, "string", split=False)) == [["a;b"]]
    assert _one(spark, "array<string>", [["a", None, " "], None], lambda c: X.as_list(c, "array<string>")) == [["a"], []]


def test_hashes(spark):
    import hashlib

    values = ["x", "清华", ""]
    assert _one(spark, "string", values, lambda c: X.stable_bucket(c, 1000)) == [int(hashlib.sha256(v.encode()).hexdigest()[:10], 16) % 1000 for v in values]
    assert _one(spark, "string", ["alice_1", "Alice", "清", None, ""], X.owner_key) == ["alice_1", *("~uid-" + hashlib.sha256(v.encode()).hexdigest() for v in ("Alice", "清")), "guest", "guest"]
