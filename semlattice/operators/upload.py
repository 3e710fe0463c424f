"""An upload of one or more tables as one job: filters, inferred mappings, quota, unique keys, contributions and a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import Mapping, Ontology
from ..plans.scratch import saved
from ..sources.tables import sheets
from .infer import infer, mappings_of
from .lifecycle import contribute, drop_blank_keys, drop_empty_rows, unique_keys, within_quota
from .mapping import apply_mapping, document_triples, source_triples, union, validate


@dataclass(frozen=True)
class Upload:
    """skip_empty: empty rows and rows without a key go. allow_generic: tables of no known class are used too."""

    max_rows: int = 5000
    skip_empty: bool = True
    allow_generic: bool = False
    include_unmapped: bool = False


def usable(mappings: Sequence[Mapping], ontology: Ontology) -> tuple[list[Mapping], list[str]]:
    """Mappings without errors, and the errors of the others as warnings: one bad mapping doesn't stop the rest."""
    checked = [(m, validate([m], ontology)) for m in mappings]
    return [m for m, errors in checked if not errors], [e for _, errors in checked for e in errors]


def upload_tables(tables: Sequence[tuple[str, DataFrame]], file: str, source_id: str, options: Upload = Upload(), ontology: Ontology = Ontology(), owner: str | None = None, partition_id: str | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Contributions, a report with a row for each table, and warnings.

    tables: (name, rows); rows have row_idx (a number, or what with_row_order() gives), which orders them, besides their columns. Filters
    come in this order: empty rows, tables of no known class, rows without a key, the quota
    over all tables. Keys are made unique among the rows that are used.
    """
    spark = tables[0][1].sparkSession
    named = [(name, [c for c in df.columns if c != "row_idx"]) for name, df in tables]
    catalog = spark.createDataFrame([(source_id, file, name, i, c) for name, columns in named for i, c in enumerate(columns)], "source_id string, file string, sheet string, column_idx int, column string")
    inferred = infer(catalog).collect()  # as many rows as the tables have columns
    kept, plans, warnings, reasons = [], {}, [], {}
    seen = {i: Observation(f"upload_seen_{i}") for i in range(len(tables))}
    for i, (name, df) in enumerate(tables):
        columns = named[i][1]
        mappings, summary = mappings_of([r for r in inferred if r["sheet"] == (name or "")], options.include_unmapped)
        df = df.observe(seen[i], F.count(F.lit(1)).alias("n"))
        rows = drop_empty_rows(df, columns) if options.skip_empty else df
        if summary["class"] == "GenericRecord" and not options.allow_generic:
            reasons[i] = "no known class"
            continue
        plans[i], bad = usable(mappings, ontology)
        warnings += bad
        kept.append((i, name, drop_blank_keys(rows, summary["id_column"]) if options.skip_empty else rows, summary["id_column"]))
    parts, used = [source_triples(spark, source_id, file)], {}
    # the rows that pass are counted by the job that writes them, which reads each input once
    passed = {i: Observation(f"upload_passed_{i}") for i, _, _, _ in kept}
    if kept:
        rows = saved(sheets([(str(i), df.observe(passed[i], F.count(F.lit(1)).alias("n"))) for i, _, df, _ in kept]))
        within = saved(within_quota(rows, options.max_rows))
        used = {r["sheet"]: r["n"] for r in within.groupBy("sheet").agg(F.count("*").alias("n")).collect()}  # one row a table
        for i, _, df, key in kept:
            own = [c for c in df.columns if c != "row_idx"]
            # at most max_rows rows
            mine = within.where(F.col("sheet") == str(i)).withColumn("nr", F.row_number().over(W.orderBy("row_idx"))).select("nr", *own)
            fixed = unique_keys(mine, key, "nr").drop("nr")
            parts += [apply_mapping(fixed, m, source_id, ontology) for m in plans[i]]
    through = {i: o.get["n"] for i, o in passed.items()}
    # tables that are refused are in no written pass
    counted = {i: seen[i].get["n"] if i in passed else tables[i][1].count() for i in range(len(tables))}
    report = spark.createDataFrame(
        [(name, counted[i], used.get(str(i), 0), counted[i] - through.get(i, 0), through.get(i, 0) - used.get(str(i), 0), reasons.get(i)) for i, (name, _) in enumerate(tables)],
        "table string, rows_in long, rows_used long, rows_filtered long, rows_truncated long, reason string",
    )
    return contribute(union(parts), source_id, owner, partition_id), report, warnings


def upload_texts(texts: DataFrame, source_id: str, file: str, owner: str | None = None, partition_id: str | None = None) -> DataFrame:
    """Contributions of text documents (doc_id, text)."""
    return contribute(union([source_triples(texts.sparkSession, source_id, file), document_triples(texts, source_id)]), source_id, owner, partition_id)
