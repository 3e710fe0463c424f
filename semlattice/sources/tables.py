"""Readers, source catalog, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.config import TRIPLE_COLUMNS, Namespaces
from ..plans.scratch import saved

#: Kind by file extension.
KINDS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "txt": "text", "md": "text", "nt": "ntriples"}
SOURCES = "source_id string, name string, kind string, location string, rows bigint, schema array<struct<column:string,type:string>>"


def kind_of(location: str, kind: str | None = None) -> str:
    """The kind given, else by extension; 'unparsed' if unknown."""
    return kind or KINDS.get(location.rstrip("/").rpartition(".")[2].lower(), "unparsed")


def read(spark: SparkSession, location: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """Any supported file. CSV: header, BOM skipped, inferred types unless a schema is given; JSON: an array of objects or one object a line."""
    kind = kind_of(location, kind)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        options = {} if schema else {"inferSchema": True}
        df = reader.options(header=True, multiLine=True, escape='"', encoding="UTF-8", **options).csv(location)
        return df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    if kind == "json":
        return reader.option("multiLine", True).json(location)
    if kind == "jsonl":
        return reader.json(location)
    if kind == "parquet":
        return reader.parquet(location)
    if kind == "text":
        return spark.read.text(location, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    if kind == "ntriples":
        return read_ntriples(spark, location)[0]
    raise ValueError(f"no reader for {location}")


def read_checked(spark: SparkSession, location: str, kind: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a file with one record a line, and the records that don't fit the schema: (row_idx, record).

    kind: csv (with a header) or jsonl. A record that is broken, or of which a value has another type, is rejected
    as a whole and kept as it stands, with its file and place; the others go on. Both come from one pass that is written.
    """
    shape = StructType.fromDDL(f"{schema}, bad_record string")
    if kind_of(location, kind) == "csv":
        rows = spark.read.schema(shape).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_record", escape='"', encoding="UTF-8", enforceSchema=True).csv(location)
    elif kind_of(location, kind) == "jsonl":
        rows = spark.read.schema(shape).options(mode="PERMISSIVE", columnNameOfCorruptRecord="bad_record").json(location)
    else:
        raise ValueError(f"no records in {kind}")
    kept = saved(with_row_order(rows))
    return kept.where("bad_record is null").drop("bad_record", "row_idx"), kept.where("bad_record is not null").select("row_idx", F.col("bad_record").alias("record"))


def tidy(df: DataFrame) -> DataFrame:
    """NaN becomes null."""
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def with_row_order(df: DataFrame, parquet: bool = False) -> DataFrame:
    """Adds row_idx, a struct that orders rows as they stand in their files. Use it on a scan, and save before any shuffle."""
    place = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
    return df.withColumn("row_idx", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("row")))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def sheets(named: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Several tables of one source as one, with sheet_idx and sheet; columns that a table lacks are null.

    A column keeps its type if all tables that have it agree; otherwise it is text.
    """
    kinds: dict[str, set[str]] = {}
    for _, df in named:
        for c, kind in df.dtypes:
            kinds.setdefault(c, set()).add(kind)
    out = None
    for i, (name, df) in enumerate(named):
        one = df.select(F.lit(i).alias("sheet_idx"), F.lit(name).alias("sheet"), *[F.col(f"`{c}`") if len(kinds[c]) == 1 else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def register(spark: SparkSession, source_id: str, name: str, location: str, kind: str | None = None) -> DataFrame:
    """A row of the catalog: schema and row count; a file that can't be read is 'unparsed' with one row."""
    kind = kind_of(location, kind)
    try:
        df = read(spark, location, kind)
        row = (source_id, name, kind, location, df.count(), list(df.dtypes))
    except Exception:  # noqa: BLE001  any unreadable file is listed as unparsed
        row = (source_id, name, "unparsed", location, 1, [])
    return spark.createDataFrame([row], SOURCES)


def list_sources(catalog: DataFrame) -> DataFrame:
    """id, name, kind, rows and column names of each source."""
    return catalog.select("source_id", "name", "kind", "rows", F.transform("schema", lambda c: c["column"]).alias("columns")).orderBy("source_id")


def remove_source(catalog: DataFrame, source_id: str) -> DataFrame:
    return catalog.where(F.col("source_id") != source_id)


# ---- sinks


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed column order, quoted where needed."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replaces the table at the path. Triples: partition_by='p', as almost every query fixes the predicate."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


# ---- RDF


#: What an address must not hold as it stands.
_NOT_IN_IRI = r"[\x00-\x20<>\"{}|^`\\]"


def _iri(c: Column, namespace: str) -> Column:
    """Full addresses stay; other values get the namespace. Characters that an address must not hold are escaped."""
    escaped = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(_NOT_IN_IRI), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(x)), 4, "0"))).otherwise(x)), "")
    whole = F.when(c.rlike(_NOT_IN_IRI), escaped).otherwise(c)
    return F.concat(F.lit("<"), F.when(c.contains("://"), whole).otherwise(F.concat(F.lit(namespace), whole)), F.lit(">"))


def _escaped(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _unescaped(c: Column) -> Column:
    """Escapes one by one from the left: a backslash and a sign, or the number of a character."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)((?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\)"), F.lit(1))
    signs = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}

    def plain(x: Column) -> Column:
        out = F.when(~x.startswith("\\"), x)
        # several numbers may be the two halves of one character
        out = out.when(x.rlike(r"^\\u"), F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
        out = out.when(x.rlike(r"^\\U"), F.decode(F.unhex(F.substr(x, F.lit(3))), "UTF-32"))
        for sign, value in signs.items():
            out = out.when(x == "\\" + sign, F.lit(value))
        return out.otherwise(F.substr(x, F.lit(2)))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, plain), "")).otherwise(c)


def _marked(c: Column) -> Column:
    """A line with the characters that no line holds in place of an escaped backslash and an escaped quote, so that literals end at the next quote.

    A pattern without alternatives takes long texts in a loop, where Java's would take them in a recursion.
    """
    return F.replace(F.replace(c, F.lit("\\\\"), F.lit("\n")), F.lit('\\"'), F.lit("\r"))


def _restored(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\\\")), F.lit("\r"), F.lit('\\"'))


XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def to_ntriples(triples: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:
    """One line (column value) for each triple."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(_iri(F.col(c), ns.resource))
    is_type = F.col("p") == "type"
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("@"), "o_lang"), F.concat(F.lit(f"^^<{XSD}"), "o_datatype", F.lit(">")), F.lit("")))
    target = F.when(F.col("o_kind") == "literal", literal).when(F.col("o_kind") == "blank", F.col("o")).when(is_type, _iri(F.col("o"), ns.ontology)).otherwise(node("o"))
    predicate = F.when(is_type, F.lit(f"<{RDF_TYPE}>")).otherwise(_iri(F.col("p"), ns.ontology))
    return triples.select(F.concat_ws(" ", node("s"), predicate, target, F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, ns: Namespaces = Namespaces()) -> None:
    to_ntriples(triples, ns).write.mode("overwrite").text(path)


def parse_ntriples(lines: DataFrame, ns: Namespaces = Namespaces()) -> tuple[DataFrame, DataFrame]:
    """Triples, and the lines (column value) that are none: rejected, not skipped silently."""
    address = r'[^<>"{}|^`\x00-\x20]*'
    pattern = rf'(?s)^[ \t]*(<{address}>|_:\S+)[ \t]+<({address})>[ \t]+(?:<({address})>|(_:\S+)|"([^"]*)"(?:\^\^<([^<>\s]*)>|@([A-Za-z0-9\-]+))?)[ \t]*\.[ \t]*$'
    part = lambda i: _restored(F.regexp_extract(_marked(F.col("value")), pattern, i))
    local = lambda c: local_of(_unescaped(c))
    local_of = lambda c: F.when(c.startswith(ns.resource), F.substr(c, F.lit(len(ns.resource) + 1))).when(c.startswith(ns.ontology), F.substr(c, F.lit(len(ns.ontology) + 1))).otherwise(c)
    rows = lines.where("trim(value) <> '' and not ltrim(value) like '#%'")
    good = _marked(F.col("value")).rlike(pattern)
    subject = F.regexp_replace(part(1), "^<|>$", "")
    kind = F.when(part(3) != "", "uri").when(part(4) != "", "blank").otherwise("literal")
    triples = rows.where(good).select(
        local(subject).alias("s"), F.when(part(2) == RDF_TYPE, F.lit("type")).otherwise(local(part(2))).alias("p"),
        F.when(kind == "uri", local(part(3))).when(kind == "blank", part(4)).otherwise(_unescaped(part(5))).alias("o"), kind.alias("o_kind"),
        F.nullif(F.regexp_replace(part(6), "^" + XSD.replace(".", r"\."), ""), F.lit("")).alias("o_datatype"), F.nullif(part(7), F.lit("")).alias("o_lang"),
    )
    return triples, rows.where(~good).select("value")


def read_ntriples(spark: SparkSession, path: str, ns: Namespaces = Namespaces()) -> tuple[DataFrame, DataFrame]:
    return parse_ntriples(spark.read.text(path), ns)


def encode_nodes(triples: DataFrame) -> DataFrame:
    """One JSON list [kind, value, datatype, language] for each term, as columns s, p, o: the form of snapshots."""
    simple = lambda c: F.to_json(F.array(F.when(F.col(c).startswith("_:"), F.lit("blank")).otherwise(F.lit("uri")), F.col(c)))
    return triples.select(simple("s").alias("s"), simple("p").alias("p"), F.to_json(F.when(F.col("o_kind") == "literal", F.array("o_kind", "o", "o_datatype", "o_lang")).otherwise(F.array("o_kind", "o"))).alias("o"))


def decode_nodes(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples and rejected rows; a subject must not be a literal, a predicate must be a uri, kinds must be known."""
    get = lambda c, i: F.get(F.from_json(c, "array<string>"), i)
    sound = get("s", 0).isin("uri", "blank") & (get("p", 0) == "uri") & get("o", 0).isin("uri", "blank", "literal") & get("s", 1).isNotNull() & get("p", 1).isNotNull() & get("o", 1).isNotNull()
    sound = F.coalesce(sound, F.lit(False))
    triples = encoded.where(sound).select(get("s", 1).alias("s"), get("p", 1).alias("p"), get("o", 1).alias("o"), get("o", 0).alias("o_kind"), get("o", 2).alias("o_datatype"), get("o", 3).alias("o_lang"))
    return triples.select(TRIPLE_COLUMNS), encoded.where(~sound)
