"""The graph as a stored view: reference counts of triples, changed by deltas.

A view is a folder. `sources/<source>/<generation>` holds what a source states, a row for each
triple, in folders by bucket of the subject. `counts/<version>` holds triples with the number of
sources that state them, in the same buckets. `manifests/<n>` lists which version of each bucket
holds and which sources' rows are still to be added (+1) or taken off (-1): the deltas.

A change writes the source's rows, if any, and one manifest; it is there once the manifest is.
Reading adds the deltas up. Compaction rewrites the buckets that a delta touches and leaves all
other files alone. A batch that is run again replaces its own rows and counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import TRIPLE_COLUMNS
from ..plans.scratch import saved

#: Rows of a manifest, a few for each source and bucket. kind: counts, pending or source.
_MANIFEST = "kind string, source string, generation int, change int, bucket int, version int"
#: Files of a bucket in one write, so that a subject in very many triples is several tasks' work.
SPREAD = 4


@dataclass(frozen=True)
class View:
    """path: its folder, which all executors share. buckets: of subjects; fixed once the view holds something."""

    spark: SparkSession
    path: str
    buckets: int = 64

    # ---- manifests

    def _entries(self, path: str) -> list[str]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def _manifest(self) -> tuple[int, list]:
        """Number and rows of the newest whole manifest."""
        for name in reversed(self._entries(f"{self.path}/manifests")):
            if "_SUCCESS" in self._entries(f"{self.path}/manifests/{name}"):
                return int(name), self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{name}").collect()
        return 0, []

    def _write_manifest(self, number: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{number:012d}")

    # ---- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("s"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.withColumn("bucket", self._bucket()).repartition(parts, "bucket", F.pmod(F.xxhash64("o"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _read(self, path: str, extra: str) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in TRIPLE_COLUMNS) + f"{extra}, bucket int"
        return self.spark.read.schema(schema).parquet(path)

    def _source(self, source: str, generation: int) -> DataFrame:
        return self._read(self._place(source, generation), "")

    def _place(self, source: str, generation: int) -> str:
        return f"{self.path}/sources/{source.encode().hex()}/{generation}"

    # ---- changes

    def add(self, source: str, triples: DataFrame) -> None:
        """The source states these triples, instead of what it stated before. Run again with the same rows it changes nothing."""
        number, rows = self._manifest()
        mine = [r for r in rows if r["source"] == source]
        pending = next((r["generation"] for r in mine if r["kind"] == "pending" and r["change"] == 1), None)
        live = next((r["generation"] for r in mine if r["kind"] == "source"), None)
        generation = pending if pending is not None else max([r["generation"] for r in mine], default=0) + 1
        self._write(saved(triples.select(TRIPLE_COLUMNS).dropDuplicates()), self._place(source, generation))
        if pending is not None:
            return
        out = [tuple(r) for r in rows if not (r["kind"] == "source" and r["source"] == source)]
        if live is not None:
            out.append(("pending", source, live, -1, None, None))
        self._write_manifest(number + 1, [*out, ("pending", source, generation, 1, None, None), ("source", source, generation, None, None, None)])

    def withdraw(self, source: str) -> None:
        """The source states nothing any more; what others state stays."""
        number, rows = self._manifest()
        live = next((r for r in rows if r["kind"] == "source" and r["source"] == source), None)
        if live is None:
            raise ValueError(f"{source} is not in the view")
        out = [tuple(r) for r in rows if r != live]
        mine = ("pending", source, live["generation"], 1, None, None)
        out = [r for r in out if r != mine] if mine in out else [*out, ("pending", source, live["generation"], -1, None, None)]
        self._write_manifest(number + 1, out)

    def sources(self) -> list[str]:
        return sorted(r["source"] for r in self._manifest()[1] if r["kind"] == "source")

    # ---- reading

    def _counted(self, rows: list, buckets: list[int] | None = None) -> DataFrame:
        """(triple, refs, bucket): stored counts and deltas, added up; of some buckets only, if given."""
        parts = []
        versions: dict[int, list[int]] = {}
        for r in rows:
            if r["kind"] == "counts":
                versions.setdefault(r["version"], []).append(r["bucket"])
        for version, mine in sorted(versions.items()):
            parts.append(self._read(f"{self.path}/counts/{version}", ", refs long").where(F.col("bucket").isin(mine)))
        for r in rows:
            if r["kind"] == "pending":
                parts.append(self._source(r["source"], r["generation"]).withColumn("refs", F.lit(r["change"]).cast("long")))
        out = self.spark.createDataFrame([], ", ".join(f"{c} string" for c in TRIPLE_COLUMNS) + ", refs long, bucket int")
        for p in parts:
            out = out.unionByName(p if buckets is None else p.where(F.col("bucket").isin(buckets)))
        return out.groupBy(*TRIPLE_COLUMNS, "bucket").agg(F.sum("refs").alias("refs")).where("refs > 0")

    def graph(self) -> DataFrame:
        """The distinct triples that a source states."""
        return self._counted(self._manifest()[1]).select(TRIPLE_COLUMNS)

    def references(self) -> DataFrame:
        """Triples with the number of sources that state them."""
        return self._counted(self._manifest()[1]).select(*TRIPLE_COLUMNS, "refs")

    # ---- compaction

    def compact(self) -> list[int]:
        """Folds the deltas into the counts of the buckets that they touch; returns these. Nothing changes for readers."""
        number, rows = self._manifest()
        pending = [r for r in rows if r["kind"] == "pending"]
        touched = sorted({int(name.removeprefix("bucket=")) for r in pending for name in self._entries(self._place(r["source"], r["generation"])) if name.startswith("bucket=")})
        if pending:
            self._write(saved(self._counted(rows, touched).drop("bucket")), f"{self.path}/counts/{number + 1}")
            kept = [tuple(r) for r in rows if r["kind"] == "source" or r["kind"] == "counts" and r["bucket"] not in touched]
            # a bucket without a row left has no folder
            there = {int(n.removeprefix("bucket=")) for n in self._entries(f"{self.path}/counts/{number + 1}") if n.startswith("bucket=")}
            self._write_manifest(number + 1, [*kept, *[("counts", None, None, None, b, number + 1) for b in touched if b in there]])
        return touched
