"""Streams that maintain views, tables and exports by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.dml import VersionedTable, upsert
from gristmill.operators.views import View
from gristmill.sources.files import export, export_records


def file_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def maintain_view(stream: DataFrame, view: View, source: VersionedTable, target: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Ingest a stream: append each batch to the source table and merge its delta into the view.

    A batch is of inserts, so its merge reads the view and the batch alone. Old versions of the view go."""

    def step(batch: DataFrame, number: int) -> None:
        changes = batch.withColumn("op", F.lit(1)).persist()
        had_view = target.exists()
        new = source.append(changes.drop("op"), f"batch-{number}")
        if not had_view:
            target.publish(view.batch(source.read()))
        elif new:
            target.publish(view.merge(target.read(), changes))
        else:  # a batch that is tried again: whether its delta is in the view is not known
            target.publish(view.batch(source.read()))
        target.vacuum()
        source.vacuum()
        changes.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, target: VersionedTable, key: list[str], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Keep one row a key: later batches replace earlier ones."""

    def step(batch: DataFrame, _: int) -> None:
        have = target.read() if target.exists() else batch.limit(0)
        target.publish(upsert(have, batch, key, order=order))
        target.vacuum()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export_stream(stream: DataFrame, target: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append-only export of a stream with its metadata columns; the batch number is the transaction."""
    step = lambda batch, n: export(export_records(batch, transaction=n), target, **options)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Event-time buckets with a watermark: bounded state, rows later than ``late`` are dropped."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("bucket"), *keys, "n", "total")
