"""Turtle: statements grouped by subject, one a line, written and read with column functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import TRIPLE_COLUMNS, Namespaces
from ..plans.scratch import ranked
from .tables import RDF_TYPE, XSD, _escaped, _iri, _marked, _restored, _unescaped

#: Names that stand behind a prefix; all other addresses are written in full.
_NAME = r"^[A-Za-z_][A-Za-z0-9_\-]*$"
_ADDRESS = r'[^<>"{}|^`\x00-\x20]*'
_TOKEN = rf'(?s)(<{_ADDRESS}>|"[^"]*"(?:\^\^(?:<{_ADDRESS}>|[A-Za-z]*:[A-Za-z0-9_\-]+)|@[A-Za-z0-9\-]+)?|_:[^\s;,]+|[A-Za-z]*:[A-Za-z0-9_\-]*|\ba\b|[;,.])'


def prefixes(ns: Namespaces = Namespaces()) -> dict[str, str]:
    return {"r": ns.resource, "o": ns.ontology, "xsd": XSD}


def to_turtle(triples: DataFrame, ns: Namespaces = Namespaces(), most: int = 1000) -> DataFrame:
    """Lines (column value), a statement each: a subject with its predicates (;) and their objects (,), in order; repeated triples once.

    A subject with more than `most` triples has several statements, so no line grows with the data; its triples
    are numbered by ranges. The prefixes stand in write_turtle()'s files.
    """
    short = lambda c, prefix, space: F.when(c.rlike(_NAME), F.concat(F.lit(f"{prefix}:"), c)).otherwise(_iri(c, space))
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(short(c, "r", ns.resource))
    tag = F.coalesce(F.concat(F.lit("@"), "o_lang"), F.concat(F.lit("^^xsd:"), "o_datatype"), F.lit(""))
    is_type = F.col("p") == "type"
    target = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tag)).when(F.col("o_kind") == "blank", F.col("o"))
    target = target.when(is_type, short(F.col("o"), "o", ns.ontology)).otherwise(node(F.col("o")))
    terms = triples.select(TRIPLE_COLUMNS).distinct().select(node(F.col("s")).alias("s"), F.when(is_type, F.lit("a")).otherwise(short(F.col("p"), "o", ns.ontology)).alias("p"), target.alias("o"))
    cut = ranked(terms, ["s"], [F.col("p"), F.col("o")], "nr").withColumn("part", F.floor((F.col("nr") - 1) / most))
    lists = cut.groupBy("s", "part", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("objects"))
    return lists.groupBy("s", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "objects"))), lambda x: F.concat_ws(" ", x["p"], x["objects"])), " ; ").alias("rest")).select(F.concat_ws(" ", "s", "rest", F.lit(".")).alias("value"))


def write_turtle(triples: DataFrame, path: str, ns: Namespaces = Namespaces()) -> None:
    """Text files of statements, each with the prefixes before them."""
    head = [f"@prefix {p}: <{address}> ." for p, address in prefixes(ns).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if not begun and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
                begun = True
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])

    to_turtle(triples, ns).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def parse_turtle(lines: DataFrame, ns: Namespaces = Namespaces()) -> tuple[DataFrame, DataFrame]:
    """Triples, and the lines (column value) that hold no whole statement: rejected, not skipped silently.

    Prefixes may stand in any line of their own and hold everywhere; one that has two addresses, or none, is an error.
    """
    directive = r"^[ \t]*@prefix[ \t]+([A-Za-z]*):[ \t]*<([^<>\s]*)>[ \t]*\.[ \t]*$"
    rows = lines.where("trim(value) <> '' and not ltrim(value) like '#%'")
    given = rows.where(F.col("value").rlike(directive)).select(F.regexp_extract("value", directive, 1).alias("k"), F.regexp_extract("value", directive, 2).alias("v")).distinct().limit(1001).collect()
    known = prefixes(ns) | {r["k"]: r["v"] for r in given}
    if len({r["k"] for r in given}) < len(given):
        raise ValueError("a prefix has two addresses")
    statements = rows.where(~F.col("value").rlike(directive)).withColumn("marked", _marked(F.col("value")))
    statements = statements.select("value", "marked", F.regexp_extract_all("marked", F.lit(_TOKEN), F.lit(1)).alias("tokens"))
    clean = (F.trim(F.regexp_replace("marked", _TOKEN, "")) == "") & (F.size("tokens") >= 4) & (F.element_at("tokens", -1) == ".")
    state = "struct<s:string,p:string,out:array<struct<p:string,o:string>>>"
    none = F.lit(None).cast("string")

    def step(acc: Column, x: Column) -> Column:
        part = lambda s, p, out: F.struct(s.alias("s"), p.alias("p"), out.alias("out"))
        told = part(acc["s"], acc["p"], F.concat(acc["out"], F.array(F.struct(acc["p"].alias("p"), x.alias("o")))))
        return F.when(x == ";", part(acc["s"], none, acc["out"])).when(x.isin(",", "."), acc).when(acc["s"].isNull(), part(x, acc["p"], acc["out"])).when(acc["p"].isNull(), part(acc["s"], x, acc["out"])).otherwise(told)

    start = F.struct(none.alias("s"), none.alias("p"), F.array().cast("array<struct<p:string,o:string>>").alias("out")).cast(state)
    read = statements.where(clean).select(F.aggregate("tokens", start, step).alias("x")).select(F.col("x.s").alias("s"), F.explode("x.out").alias("x")).select("s", "x.p", "x.o")
    spaces = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])

    def address(c: Column) -> Column:
        full = F.when(c.startswith("<"), _unescaped(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(F.concat(F.element_at(spaces, F.substring_index(c, ":", 1)), F.substr(c, F.instr(c, ":") + 1)))
        return F.when(full.startswith(ns.resource), F.substr(full, F.lit(len(ns.resource) + 1))).when(full.startswith(ns.ontology), F.substr(full, F.lit(len(ns.ontology) + 1))).otherwise(full)

    literal = r'(?s)^"([^"]*)"(?:\^\^(.*)|@(.*))?$'
    kind = F.when(F.col("o").startswith('"'), "literal").when(F.col("o").startswith("_:"), "blank").otherwise("uri")
    datatype = F.regexp_extract("o", literal, 2)
    full_type = F.when(datatype.startswith("<"), F.substr(datatype, F.lit(2), F.length(datatype) - 2)).otherwise(F.concat(F.element_at(spaces, F.substring_index(datatype, ":", 1)), F.substr(datatype, F.instr(datatype, ":") + 1)))
    out = read.select(
        F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(address(F.col("s"))).alias("s"), F.when(F.col("p").isin("a", f"<{RDF_TYPE}>"), F.lit("type")).otherwise(address(F.col("p"))).alias("p"),
        F.when(kind == "literal", _unescaped(_restored(F.regexp_extract("o", literal, 1)))).when(kind == "blank", F.col("o")).otherwise(address(F.col("o"))).alias("o"), kind.alias("o_kind"),
        F.when(datatype != "", F.replace(full_type, F.lit(XSD), F.lit(""))).alias("o_datatype"), F.nullif(F.regexp_extract("o", literal, 3), F.lit("")).alias("o_lang"))
    return out, statements.where(~clean).select("value")


def read_turtle(spark: SparkSession, path: str, ns: Namespaces = Namespaces()) -> tuple[DataFrame, DataFrame]:
    return parse_turtle(spark.read.text(path), ns)
