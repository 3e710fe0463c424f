"""Sources that grow: new files are mapped as they come and appended to the contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.lifecycle import contribute
from ..operators.mapping import ingest
from ..operators.view import View
from ..plans.config import Mapping, Ontology


def stream_source(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A streaming read of the folder's files."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(folder)


def append_contributions(stream: DataFrame, mappings: Sequence[Mapping], source_id: str, name: str, table: str, checkpoint: str, ontology: Ontology = Ontology(), available_now: bool = True):
    """Starts a query that maps each batch and writes it under table/batch=<id>.

    A batch that is run again after a failure replaces its own folder, so nothing is counted
    twice; the graph view over the table equals that of one batch job over all files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        contribute(ingest(batch, mappings, source_id, name, ontology), source_id).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_to_view(stream: DataFrame, mappings: Sequence[Mapping], source_id: str, name: str, view: View, checkpoint: str, ontology: Ontology = Ontology(), available_now: bool = True):
    """Starts a query that adds each batch to a view with reference counts, as a source <source_id>/<batch>.

    A batch that is run again after a failure replaces its own rows, so nothing is counted twice; withdraw_stream()
    takes all of a stream's batches off again.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        view.add(f"{source_id}/{batch_id}", ingest(batch, mappings, source_id, name, ontology))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def withdraw_stream(view: View, source_id: str) -> None:
    """Withdraws all batches of a stream from the view."""
    for source in view.sources():
        if source.startswith(f"{source_id}/"):
            view.withdraw(source)
