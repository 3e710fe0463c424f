"""Rows to triples by declarative mappings: projections and explodes, no shuffle before the final distinct."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_list, from_template, not_blank, strip, typed_form
from ..plans.config import TRIPLE_COLUMNS, TRIPLES, EntityMapping, Mapping, Ontology, RelationMapping

BUILT_IN = ("type", "name", "cnLabel", "sourcedFrom", "sameAs")


def triple(s: Column, p: str, o: Column, kind: str, datatype: str | None = None) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))


def _exploded(df: DataFrame, triples: dict[str, Column], only: Collection[str] | None = None) -> DataFrame:
    """The triples by predicate as rows, those of the predicates in `only` if given."""
    wanted = [t for p, t in triples.items() if only is None or p.split("#")[0] in only]
    if not wanted:
        return df.sparkSession.createDataFrame([], TRIPLES)
    return df.select(F.explode(F.array(*wanted)).alias("t")).select("t.*").where("s is not null and o is not null").select(TRIPLE_COLUMNS)


def validate(mappings: Iterable[Mapping], ontology: Ontology = Ontology()) -> list[str]:
    """Names that the ontology lacks, as messages; relation mappings are checked like entity mappings."""
    errors = []
    for m in mappings:
        classes = [m.cls] if isinstance(m, EntityMapping) else [m.subject_class, m.object_class]
        errors += [f"unknown class {c}" for c in classes if c not in ontology.classes]
        if isinstance(m, EntityMapping):
            errors += [f"unknown property {p.property}" for p in m.properties if p.property not in (*ontology.properties, *BUILT_IN)]
        elif m.predicate not in ontology.relations:
            errors.append(f"unknown relation {m.predicate}")
    return errors


def entity_triples(rows: DataFrame, m: EntityMapping, source_id: str, only: Collection[str] | None = None) -> DataFrame:
    """type, sourcedFrom, name (the k-th label of the k-th id) and properties of each row's entities; of the predicates in `only`, if given.

    Blank ids give nothing. Values that their datatype can't take are left out.
    """
    kinds = dict(rows.dtypes)
    ids = as_list(F.col(m.id_column), kinds[m.id_column], m.multi_value)
    labels = as_list(F.col(m.label_column), kinds[m.label_column], m.multi_value) if m.label_column else F.array().cast("array<string>")
    values = {p: as_list(F.col(p.column), kinds[p.column]) if p.multi_value or kinds[p.column].startswith("array") else F.col(p.column).cast("string") for p in m.properties}
    base = rows.select(ids.alias("ids"), labels.alias("labels"), *[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    each = base.select(F.posexplode("ids").alias("k", "id"), "labels", *[f"v{i}" for i in range(len(values))]).withColumn("s", from_template(m.id_template, F.col("id")))
    s = F.col("s")
    out = {"type": triple(s, "type", F.lit(m.cls), "uri"), "sourcedFrom": triple(s, "sourcedFrom", F.lit(f"ds_{source_id}"), "uri")}
    if m.label_column:
        out["name"] = triple(s, "name", F.get("labels", F.col("k")), "literal")
    for i, p in enumerate(m.properties):
        listed = p.multi_value or kinds[p.column].startswith("array")
        value = F.get(F.col(f"v{i}"), F.col("k")) if listed else F.col(f"v{i}")
        form, datatype = typed_form(value, p.datatype)
        # several columns may give one property
        out[f"{p.property}#{i}"] = triple(s, p.property, F.when(not_blank(value), form), "literal", datatype)
    return _exploded(each, out, only)


def relation_triples(rows: DataFrame, m: RelationMapping, source_id: str, only: Collection[str] | None = None) -> DataFrame:
    """An edge from each subject to each object of a row, and the object's type; its name too if objects come from values."""
    kinds = dict(rows.dtypes)
    subjects = as_list(F.col(m.subject_id_column), kinds[m.subject_id_column], m.multi_subject)
    objects = as_list(F.col(m.object_id_column), kinds[m.object_id_column], m.multi_object)
    each = rows.select(subjects.alias("ss"), objects.alias("os")).select(F.explode("ss").alias("a"), "os").select("a", F.explode("os").alias("b"))
    each = each.select(from_template(m.subject_id_template, F.col("a")).alias("s"), from_template(m.object_id_template, F.col("b")).alias("b_id"), strip(F.col("b")).alias("b"))
    out = {"type": triple(F.col("b_id"), "type", F.lit(m.object_class), "uri"), m.predicate: triple(F.col("s"), m.predicate, F.col("b_id"), "uri")}
    if m.from_value:
        out["name"] = triple(F.col("b_id"), "name", F.col("b"), "literal")
    return _exploded(each, out, only)


def apply_mapping(rows: DataFrame, m: Mapping, source_id: str, ontology: Ontology = Ontology(), only: Collection[str] | None = None) -> DataFrame:
    """The mapping's triples; only: predicates that are asked for, so that no others are built."""
    if errors := validate([m], ontology):
        raise ValueError("; ".join(errors))
    return entity_triples(rows, m, source_id, only) if isinstance(m, EntityMapping) else relation_triples(rows, m, source_id, only)


def document_triples(docs: DataFrame, source_id: str, id_column: str = "doc_id", name_column: str | None = None, prefix: str = "doc_", limit: int = 1500) -> DataFrame:
    """A Dataset entity for each text: name, and its first characters as description."""
    rows = docs.where(F.col(id_column).isNotNull()).select(from_template(prefix + "{id}", F.col(id_column)).alias("s"), F.col(name_column or id_column).cast("string").alias("n"), F.substring("text", 1, limit).alias("d"))
    s = F.col("s")
    return _exploded(rows, {"type": triple(s, "type", F.lit("Dataset"), "uri"), "sourcedFrom": triple(s, "sourcedFrom", F.lit(f"ds_{source_id}"), "uri"), "name": triple(s, "name", F.col("n"), "literal"), "description": triple(s, "description", F.when(not_blank(F.col("d")), F.col("d")), "literal")})


def source_triples(spark: SparkSession, source_id: str, name: str) -> DataFrame:
    """The source itself as an entity."""
    one = spark.range(1).select(F.lit(f"ds_{source_id}").alias("s"))
    return _exploded(one, {"type": triple(F.col("s"), "type", F.lit("DataSource"), "uri"), "name": triple(F.col("s"), "name", F.lit(name), "literal")})


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ingest(rows: DataFrame, mappings: Sequence[Mapping], source_id: str, name: str, ontology: Ontology = Ontology()) -> DataFrame:
    """All triples that a source emits, not yet distinct."""
    return union([source_triples(rows.sparkSession, source_id, name), *[apply_mapping(rows, m, source_id, ontology) for m in mappings]])


def emitted_counts(contributions: DataFrame) -> DataFrame:
    """Emitted and distinct triples of each source."""
    return contributions.groupBy("source_id").agg(F.count("*").alias("emitted"), F.countDistinct(F.struct(*TRIPLE_COLUMNS)).alias("triples"))


def build_graph(sources: Sequence[tuple[str, str, DataFrame, Sequence[Mapping]]], ontology: Ontology = Ontology()) -> DataFrame:
    """The distinct triples of all sources (id, name, rows, mappings): one lazy union, one shuffle."""
    return union([ingest(rows, mappings, sid, name, ontology) for sid, name, rows, mappings in sources]).dropDuplicates()
