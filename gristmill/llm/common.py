"""Shared storage helpers of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset in a local session (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        found = os.path.join(tempfile.gettempdir(), f"gristmill-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit; nothing depends on the removal
        pass


#: Without a second file for each file's checksums, which Hadoop's local file system would start one more process for;
#: other file systems do not read this.
_BARE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, label: str, bare: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    Survives lost executors. The files go when the process ends. ``bare``: a local folder gets no checksum files; the
    checksums in Parquet's pages are held against the data in their place.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gristmill/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(_BARE if bare else {})).parquet(path)
    atexit.register(_remove, spark, path)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).options(**({"parquet.page.verify-checksum.enabled": "true"} if bare else {})).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


_PATHS: dict[int, tuple[DataFrame, str]] = {}


def discard(*frames: DataFrame) -> None:
    """Remove the files of materialized frames that nothing will read again."""
    for df in frames:
        found = _PATHS.pop(id(df), None)
        if found:
            _remove(df.sparkSession, found[1])


@contextmanager
def owned() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove, at the end of the block, all that was materialized in it but for the frames given to the function it yields.

    For a block that has written its result: what the result was made from is then of no more use.
    """
    before, kept = set(_PATHS), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    yield keep
    discard(*[df for k, (df, _) in list(_PATHS.items()) if k not in before and k not in kept])


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of one Arrow batch, since texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def gapless(df: DataFrame, group: list[str], spread: Column, order: list, out: str, first: int = 0, bucket_rows: int = 100_000) -> DataFrame:
    """Add ``out``: gapless numbers from ``first`` within each group, without one task per group.

    Rows are dealt into buckets by ``spread`` (a long hash of the row); buckets are counted by a partial
    aggregate, the counts are summed into offsets, and rows are numbered within (group, bucket) only. The
    number of buckets follows the number of rows, so no window holds more than about ``bucket_rows`` rows.
    """
    total = df.count()
    buckets = max(16, -(-total // bucket_rows) * 4)
    keyed = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most groups x buckets rows: bounded by rows / bucket_rows for each group
    on = [F.col(c) for c in group]
    from pyspark.sql import Window

    offsets = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    ).drop("_n")
    within = Window.partitionBy(*on, F.col("_bucket")).orderBy(*order)
    numbered = keyed.withColumn("_in", F.row_number().over(within).cast("long") - 1)
    joined = numbered.join(offsets, [*group, "_bucket"])
    return joined.withColumn(out, F.col("_in") + F.col("_before") + F.lit(first)).drop("_in", "_before", "_bucket")
