from __future__ import annotations

import importlib.util
import os
import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gristmill.plans.procedures import Engine
from gristmill.sources import files
from gristmill.streaming import incremental

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc_export_and_parallel_read(spark):
    url = "jdbc:derby:memory:gristmill;create=true"
    try:
        spark._jvm.java.lang.Class.forName(DERBY)
    except Exception:
        pytest.skip("no JDBC driver at hand")
    df = spark.range(100).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V"))
    files.export(df, "jdbc", url=url, dbtable="T", driver=DERBY)
    got = files.read_jdbc(spark, url, "T", column="K", bounds=(0, 100), partitions=4, driver=DERBY)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(100)]


ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession, functions as F
from gristmill.plans import catalogue
from gristmill.sources import files

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": sys.argv[1] + "/shared", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": sys.argv[1] + "/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
files.STAGED_ROWS = 300
assert sorted(map(tuple, catalogue.QUERIES["jdbc_roundtrip"](spark, sys.argv[2]).collect())) == sorted(map(tuple, spark.read.parquet(sys.argv[2] + "/nation.parquet").select("n_nationkey", "n_name").collect()))

url, driver = "jdbc:derby:memory:odd;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
k = F.col("id")
odd = spark.range(0, 2000, 1, 3).select(
    k.alias("K"), F.when(k % 3 != 0, F.concat(F.lit("x'\u00e9\U0001f600"), k)).alias("S"), F.when(k % 5 != 0, k / 7).alias("D"), (k % 2 == 0).alias("B"),
    F.when(k % 4 != 0, (k / 8).cast("decimal(12,3)")).alias("N"), F.date_add(F.lit("1969-12-30").cast("date"), k.cast("int")).alias("T"), F.timestamp_micros(k * 1000001 - 5).alias("U"), F.encode(k.cast("string"), "utf-8").alias("X"),
)
seen = lambda df: sorted(map(str, df.select("K", "S", "D", "B", F.col("N").cast("decimal(12,3)").alias("N"), "T", "U", "X").collect()))
for times in (1, 2):  # the second batch goes on to the same table
    files.export(odd, "jdbc", url=url, dbtable="ODD", driver=driver)
    parallel = files.read_jdbc(spark, url, "ODD", column="K", bounds=(10, 1500), partitions=4, driver=driver)
    assert seen(parallel) == sorted(seen(odd) * times)
assert seen(files.read_jdbc(spark, url, "ODD", driver=driver)) == seen(parallel)
files.export(odd.filter("K < 0"), "jdbc", url=url, dbtable="EMPTY", driver=driver)
assert files.read_jdbc(spark, url, "EMPTY", column="K", bounds=(0, 9), partitions=3, driver=driver).collect() == []
try:
    files.export(spark.range(3).select(k.alias("K"), F.lit("no").alias("D")), "jdbc", url=url, dbtable="ODD", driver=driver)
except Exception:
    print("all of it")
"""


def test_jdbc_reaches_an_embedded_database_from_a_cluster(tmp_path, sf_dir):
    home = tmp_path / "home"  # the executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in pathlib.Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path), sf_dir], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.split("\n")[0] == "all of it", done.stderr[-3000:]


def test_snapshots(spark, tmp_path):
    tables = {"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("y")}
    files.snapshot_save(tables, str(tmp_path), "n1")
    with pytest.raises(Exception):
        files.snapshot_save(tables, str(tmp_path), "n1")
    files.snapshot_to_csv(spark, str(tmp_path), "n1", "a", str(tmp_path / "csv"))
    assert sorted(r[0] for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()) == ["0", "1", "2"]
    assert files.snapshot_restore(spark, str(tmp_path), "n1", "b").count() == 2


def test_export_record_columns(spark):
    out = files.export_records(spark.range(4).toDF("x"), "DELETE", transaction=9)
    assert out.columns == ["export_transaction", "export_time", "export_sequence", "export_partition", "export_site", "export_op", "x"]
    rows = out.collect()
    assert {r["export_op"] for r in rows} == {0} and {r["export_transaction"] for r in rows} == {9} and len({r["export_sequence"] for r in rows}) == 4
    with pytest.raises(ValueError):
        files.export(out, "nowhere")


def test_custom_export(spark, tmp_path):
    at = str(tmp_path)

    def send(rows):
        import uuid

        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{r['x']}\n" for r in rows)

    files.export_custom(spark.range(5).toDF("x").repartition(2), send)
    assert sorted(int(x) for p in tmp_path.iterdir() if not p.name.startswith(".") for x in p.read_text().split()) == [0, 1, 2, 3, 4]


def test_tumbling_windows_with_a_watermark(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, id % 2 AS k, id AS v FROM range(30)")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), "ts timestamp, k long, v long")
    query = incremental.tumbling(stream, "ts", "10 seconds", "0 seconds", ["k"], "v").writeStream.format("memory").queryName("tumbling_out").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["bucket"].second, r["k"], r["n"], r["total"]) for r in spark.table("tumbling_out").collect())
    assert got == sorted((b * 10, k, 5, sum(i for i in range(b * 10, b * 10 + 10) if i % 2 == k)) for b in range(3) for k in (0, 1))


def test_catalog(spark):
    spark.range(1).toDF("x").createOrReplaceTempView("catalog_probe")
    e = Engine(spark)
    assert "catalog_probe" in [r[0] for r in e.catalog().collect()]
    assert ("catalog_probe", "x") in [(r[0], r[1]) for r in e.catalog("columns").collect()]
