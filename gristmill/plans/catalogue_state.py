"""Catalogue entries for table rewrites, views, retention, streams, sinks and procedures."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import dates
from gristmill.operators import dml, views
from gristmill.plans.procedures import Engine
from gristmill.sources import files
from gristmill.streaming import incremental
from gristmill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def entry(name: str, sql: str | None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share: in spark.checkpoint.dir, else a temporary one (local runs)."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        base = tempfile.mkdtemp(prefix="gristmill-")
    return f"{base.rstrip('/')}/state-{uuid.uuid4().hex}"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@entry("dml_insert_select", f"SELECT {_O} FROM orders UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'N', NULL FROM orders WHERE o_custkey < 50")
def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    new = t.filter("o_custkey < 50").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), "o_custkey")
    return dml.insert(t, new, {"o_orderstatus": "N"})


@entry("dml_upsert", f"SELECT {_O} FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -1, 'N', o_totalprice * 2 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 10000000 + n_nationkey, -1, 'N', 1.0 FROM nation")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    old = t.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(1).alias("at"))
    twice = old.withColumns({"o_totalprice": F.lit(0.0), "at": F.lit(0)})
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10000000).cast("bigint").alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"), F.lit(1).alias("at"))
    return dml.upsert(t, old.unionByName(twice).unionByName(new), ["o_orderkey"], {"o_orderstatus": "N", "o_custkey": -1}, order="at")


@entry("dml_update", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update(_orders(spark, sf_dir), F.col("o_totalprice") > 100000, {"o_custkey": F.col("o_custkey") + 1, "o_orderstatus": F.lit("X")}, partition_column="o_orderkey")


@entry("dml_delete", f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F' OR o_totalprice <= 50000")
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(_orders(spark, sf_dir), (F.nullif(F.col("o_orderstatus"), F.lit("F")).isNotNull()) & (F.col("o_totalprice") > 50000))


@entry("dml_delete_order_limit", f"SELECT {_O} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 5)")
def _delete_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete_ordered(_orders(spark, sf_dir), ["o_orderkey"], [F.col("o_totalprice"), F.col("o_orderkey")], 100, 5)


@entry("dml_truncate", f"SELECT {_O} FROM orders WHERE 1 = 0")
def _truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.truncate(_orders(spark, sf_dir))


def _view(where: str | None = None) -> views.View:
    keys = {"event_type": F.nullif(F.col("event_type"), F.lit("view")), "hour_of_day": F.hour("ts").cast("bigint")}
    measures = {"total": ("sum", "amount"), "filled": ("count", "amount"), "lo": ("min", "amount"), "hi": ("max", "amount")}
    return views.View(keys, measures, None if where is None else F.expr(where))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("amount", F.nullif((F.col("value") * 100).cast("bigint") % 50, F.lit(0)))


_VIEW = (
    "SELECT nullif(event_type, 'view') AS event_type, CAST(hour(ts) AS BIGINT) AS hour_of_day, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total, count(amount) AS filled, min(amount) AS lo, max(amount) AS hi "
    "FROM (SELECT *, nullif(CAST(trunc(value * 100) AS BIGINT) % 50, 0) AS amount FROM events) e {} GROUP BY ALL"
)


@entry("view_batch", _VIEW.format(""))
def _view_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view().batch(_events(spark, sf_dir))


@entry("view_filtered", _VIEW.format("WHERE user_id % 5 > 1"))
def _view_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view("user_id % 5 > 1").batch(_events(spark, sf_dir))


@entry("view_incremental_equals_batch", _VIEW.format(""))
def _view_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, view = _events(spark, sf_dir), _view()
    have = view.batch(events.filter("event_id % 3 = 0"))
    for k in (1, 2):
        have = view.merge(have, events.filter(f"event_id % 3 = {k}").withColumn("op", F.lit(1)))
    return have


@entry("view_after_deletes", _VIEW.format("WHERE NOT (event_id % 4 = 1 OR hour(ts) = 3)"))
def _view_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, view = _events(spark, sf_dir), _view()
    gone = (F.col("event_id") % 4 == 1) | (F.hour("ts") == 3)
    return view.merge(view.batch(events), events.filter(gone).withColumn("op", F.lit(-1)), events.filter(~gone))


@entry("view_regrouped", "SELECT nullif(event_type, 'view') AS event_type, count(*) AS n FROM events GROUP BY ALL")
def _view_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view().batch(_events(spark, sf_dir)).groupBy("event_type").agg(F.sum("n").alias("n"))


@entry("retention_row_limit", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.keep_newest(table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 100)


@entry("retention_age", "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def _age(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    newest = events.agg(F.max("ts").alias("newest"))  # one row
    return views.keep_after(events.join(F.broadcast(newest)), "ts", F.col("newest") - F.expr("INTERVAL 2 DAYS")).select("event_id", "ts")


@entry("tumbling_second", "SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS second_ts, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(dates.truncate("SECOND", F.col("ts")).alias("second_ts")).agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))


_LAST = "SELECT CAST(sum(total) AS BIGINT) // CAST(sum(n) AS BIGINT) AS average FROM (SELECT date_trunc('second', ts) AS s, count(*) AS n, sum(user_id) AS total FROM events GROUP BY 1) v WHERE s >= (SELECT date_trunc('second', max(ts)) - INTERVAL 6 HOUR FROM events)"


@entry("sliding_last_n", _LAST)
def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_second = _tumbling(spark, sf_dir)
    newest = per_second.agg(F.max("second_ts").alias("newest"))  # one row
    recent = per_second.join(F.broadcast(newest)).filter(dates.since_epoch("SECOND", F.col("second_ts")) >= dates.since_epoch("SECOND", F.col("newest")) - 6 * 3600)
    return recent.agg(F.expr("sum(total) div sum(n)").alias("average"))


@entry("proc_average_window", _LAST)
def _average(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tumbling(spark, sf_dir).createOrReplaceTempView("agg_by_second")
    engine = Engine(spark)
    engine.create_procedure("Average", "SELECT sum(total) div sum(n) AS average FROM agg_by_second WHERE unix_micros(CAST(second_ts AS TIMESTAMP)) div 1000000 >= (SELECT max(unix_micros(CAST(second_ts AS TIMESTAMP)) div 1000000) FROM agg_by_second) - :seconds")
    return engine.call("Average", seconds=6 * 3600)


@entry("approx_distinct_hll", "SELECT event_type, count(DISTINCT user_id) AS exact, true AS within FROM events GROUP BY event_type")
def _hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of 2^12 registers kept by group, merged and estimated: within 5 % of the exact count (3 standard errors), or 2."""
    events = table(spark, sf_dir, "events")
    sketches = events.groupBy("event_type", F.hour("ts").alias("h")).agg(F.hll_sketch_agg("user_id", 12).alias("sketch"))
    merged = sketches.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("devices"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return merged.join(exact, "event_type").select("event_type", "exact", (F.abs(F.col("devices") - F.col("exact")) <= F.greatest(F.lit(2.0), F.col("exact") * 0.05)).alias("within"))


@entry("stream_file_source_agg", "SELECT nullif(event_type, 'view') AS event_type, CAST(hour(ts) AS BIGINT) AS hour_of_day, count(*) AS n FROM events GROUP BY ALL")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive one a batch; each batch is appended and merged into the view."""
    at = _folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id")
    events.repartition(3, "event_id").write.parquet(f"{at}/in")
    stream = incremental.file_stream(spark, f"{at}/in", "event_id long, ts timestamp_ntz, event_type string, user_id long")
    source, target = dml.VersionedTable(spark, f"{at}/source"), dml.VersionedTable(spark, f"{at}/view")
    view = views.View({"event_type": F.nullif(F.col("event_type"), F.lit("view")), "hour_of_day": F.hour("ts").cast("bigint")})
    incremental.maintain_view(stream, view, source, target, f"{at}/checkpoint").awaitTermination()
    return target.read()


_EXPORTED = "SELECT CAST({} AS TINYINT) AS export_op, CAST(7 AS BIGINT) AS export_transaction, 0 AS export_site, true AS timed, true AS numbered, r_regionkey, r_name FROM region {}"


@entry("export_with_metadata", f"{_EXPORTED.format(1, '')} UNION ALL {_EXPORTED.format(0, 'WHERE r_regionkey > 2')}")
def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six metadata columns: times of this run, and sequence numbers without gaps within each partition."""
    region = table(spark, sf_dir, "region")
    records = files.export_records(region, transaction=7).unionByName(files.export_records(region.filter("r_regionkey > 2"), "DELETE", transaction=7))
    at = _folder(spark)
    files.export(records, "file", path=at)
    got = spark.read.schema(records.schema).csv(at)
    here = Window.partitionBy("export_op", "export_partition")
    numbered = F.max("export_sequence").over(here) - F.min("export_sequence").over(here) + 1 == F.count(F.lit(1)).over(here)
    timed = F.abs(F.unix_millis(F.current_timestamp()) - F.col("export_time")) < 3_600_000
    return got.select("export_op", "export_transaction", "export_site", timed.alias("timed"), numbered.alias("numbered"), "r_regionkey", "r_name")


@entry("snapshot_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    files.snapshot_save({"nation": table(spark, sf_dir, "nation")}, at, "first")
    return files.snapshot_restore(spark, at, "first", "nation")


@entry("csv_load_options", "SELECT s_suppkey, s_name, nullif(s_acctbal, s_acctbal) AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 1")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    at = _folder(spark)
    blanked = supplier.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 2 == 1, F.col("s_acctbal")))
    blanked.write.option("sep", "|").csv(at)
    return files.read_csv(spark, at, supplier.schema, separator="|", blank="null")[0]


@entry("bulk_load", "SELECT r_regionkey, r_name FROM region")
def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, at = table(spark, sf_dir, "region"), _folder(spark)
    loader = files.BulkLoader(spark, at, region.schema, batch=2)
    for row in region.collect():  # 5 rows at any scale: the client side of the loader
        loader.insert_row(row[0], *row)
    loader.close()
    return spark.read.schema(region.schema).parquet(at)


@entry("statistics_row_counts", "SELECT 'nation' AS table_name, count(*) AS tuple_count FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return Engine(spark).statistics(["nation", "region"])
