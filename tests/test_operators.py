from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators import dml, joins, relational, views
from gristmill.plans.procedures import Abort, Engine, convert, expect
from gristmill.sources import files
from gristmill.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_left_join_predicates(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "k int, x int")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (None, "r")], "j int, y string")
    on = F.col("k") == F.col("j")
    assert rows(joins.left_outer(a, b, on, pre=F.col("x") > 5)) == rows(spark.createDataFrame([(1, 5, None, None), (2, 6, 2, "q"), (None, 7, None, None)], "k int, x int, j int, y string"))
    assert rows(joins.left_outer(a, b, on, where=F.col("y").isNull())) == [(None, 7, None, None)]


def test_range_join_equals_theta(spark):
    points = spark.range(200).select((F.col("id") * 0.7 - 20).alias("p"))
    spans = spark.range(40).select((F.col("id") * 3.0 - 10).alias("lo"), (F.col("id") * 3.5 - 8).alias("hi"))
    want = points.join(spans, F.col("p").between(F.col("lo"), F.col("hi")))
    assert rows(joins.range_join(points, spans, "p", "lo", "hi", 5.0)) == rows(want)


def test_broadcast_only_when_small(spark):
    assert "broadcast" in joins.small(spark.range(10))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.small(spark.range(10), 1)._jdf.queryExecution().logical().toString().lower()


def test_salted_join_does_not_broadcast_its_copies(spark):
    left = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    for how in ("inner", "left"):
        got = joins.salted(left, right, "k", how=how)
        assert rows(got.groupBy("k", "y").count()) == rows(left.join(right, "k", how).groupBy("k", "y").count())
        got.collect()  # the plan is final then
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_set_operations_check_types(spark):
    with pytest.raises(TypeError):
        relational.set_operation("union", spark.range(1), spark.sql("SELECT 'a'"))
    a, b = spark.createDataFrame([(1,), (1,), (None,), (2,)], "x int"), spark.createDataFrame([(1,), (None,), (None,)], "x int")
    assert rows(relational.set_operation("except all", a, b)) == [(1,), (2,)]
    assert rows(relational.set_operation("intersect all", a, b)) == [(1,), (None,)]
    assert rows(relational.set_operation("union", a, b)) == [(1,), (2,), (None,)]


def test_limits_refuse_negatives(spark):
    with pytest.raises(ValueError):
        relational.limit_offset(spark.range(3), -1)


def test_constraints_and_versions(spark, tmp_path):
    t = dml.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.publish(spark.createDataFrame([(1, "a")], "k int, v string"), unique=[["k"]], not_null=["v"])
    for bad in ([(1, "a"), (1, "b")], [(2, None)]):
        with pytest.raises(dml.ConstraintViolation):
            t.publish(spark.createDataFrame(bad, "k int, v string"), unique=[["k"]], not_null=["v"])
    assert rows(t.read()) == [(1, "a")]
    with pytest.raises(dml.ConstraintViolation):
        dml.update(t.read(), F.lit(True), {"k": F.lit(2)}, partition_column="k")
    with pytest.raises(dml.ConstraintViolation):
        dml.check(spark.range(3).toDF("k"), row_limit=2)


def test_named_parts_are_added_once(spark, tmp_path):
    t = dml.VersionedTable(spark, str(tmp_path / "t"))
    assert t.append(spark.range(3), "batch-0") and t.append(spark.range(2), "batch-1") and not t.append(spark.range(2), "batch-1")
    assert t.read().count() == 5
    t.publish(spark.range(1))
    assert t.read().count() == 1


def test_crud_and_procedures(spark, tmp_path):
    t = dml.VersionedTable(spark, str(tmp_path / "t"))
    t.publish(spark.createDataFrame([(1, "a")], "k int, v string"))
    e = Engine(spark)
    e.crud("T", t, ["k"])
    e.call("T.insert", 2, "b")
    e.call("T.upsert", 1, "z")
    e.call("T.update", 2, "y", 2)
    assert rows(t.read()) == [(1, "z"), (2, "y")] and rows(e.call("T.select", 1)) == [(1, "z")]
    with pytest.raises(dml.ConstraintViolation):
        e.call("T.insert", 2, "again")
    e.call("T.delete", 1)
    assert rows(t.read()) == [(2, "y")]

    def body(context, least):
        context.queue("SELECT count(*) AS n FROM VALUES (1), (2), (3) AS v(x) WHERE x >= :least", "SCALAR_LONG", least=least)
        n = context.execute()[0].first()[0]
        if n == 0:
            raise Abort("none")
        return n, context.random.random()

    e.create_procedure("P", body)
    assert e.call("P", 2, seed=5) == e.call("P", 2, seed=5)
    with pytest.raises(Abort):
        e.call("P", 9)
    assert "Scan" in e.explain("SELECT * FROM VALUES (1) AS v(x)") or "LocalTable" in e.explain("SELECT * FROM VALUES (1) AS v(x)")
    with pytest.raises(Abort):
        expect(spark.range(2), "ONE_ROW")
    with pytest.raises(ValueError):
        convert(-128, "tinyint")


def test_view_merges_equal_batch(spark):
    schema = "g string, h int, x int"
    base = [("a", 1, 5), ("a", 1, None), ("b", 1, 2), (None, 2, 3), ("c", 1, 9), ("a", 1, 5)]
    view = views.View({"g": F.col("g"), "h": F.col("h")}, {"s": ("sum", "x"), "c": ("count", "x"), "lo": ("min", "x"), "hi": ("max", "x")})
    have = view.batch(spark.createDataFrame(base, schema))
    gone, new = [("a", 1, 5), ("c", 1, 9), ("b", 1, 2)], [("b", 1, None), (None, 2, -4), ("d", 3, None)]
    after = list(base)
    for g in gone:
        after.remove(g)
    after += new
    changes = spark.createDataFrame([(*r, -1) for r in gone] + [(*r, 1) for r in new], schema + ", op int")
    source = spark.createDataFrame(after, schema)
    assert rows(view.merge(have, changes, source)) == rows(view.batch(source))


def test_eviction_runs_before_the_insert(spark):
    have, new = spark.range(10).toDF("k"), spark.range(100, 103).toDF("k")
    kept = views.evict_before_insert(have, new, [F.col("k")], 11, 4)
    assert rows(kept) == sorted([(k,) for k in [4, 5, 6, 7, 8, 9, 100, 101, 102]], key=str)
    kept = views.evict_before_insert(have, new, [F.col("k")], 5, 1, F.col("k") % 2)  # 5 even and 5 odd; 2 even and 1 odd come
    assert rows(kept) == sorted([(k,) for k in [3, 4, 5, 6, 7, 8, 9, 100, 101, 102]], key=str)


def test_inserts_merge_without_the_source(spark, tmp_path):
    spark.range(50).select((F.col("id") % 7).alias("g"), F.col("id").alias("x")).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    view = views.View({"g": F.col("g")}, {"s": ("sum", "x"), "lo": ("min", "x")})
    have = spark.createDataFrame(view.batch(source).collect(), view.batch(source).schema)
    new = spark.createDataFrame([(3, -9, 1), (9, 4, 1)], "g long, x long, op int")
    merged = view.merge(have, new)
    assert "parquet" not in merged._jdf.queryExecution().executedPlan().toString().lower()
    assert rows(merged) == rows(view.batch(source.unionByName(new.drop("op"))))
    with pytest.raises(Exception, match="a delete needs the source"):
        view.merge(have, new.withColumn("op", F.lit(-1))).collect()
    touched = view.merge(have, source.filter("x = 8").withColumn("op", F.lit(-1)), source.filter("x <> 8"))
    plan = touched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("LeftSemi") > plan.rindex("Aggregate [_k_g") - 10_000 and rows(touched) == rows(view.batch(source.filter("x <> 8")))


def test_pointers_survive_crashes_and_refuse_lost_updates(spark, tmp_path):
    t = dml.VersionedTable(spark, str(tmp_path / "t"))
    t.publish(spark.range(3))
    other = dml.VersionedTable(spark, t.path)
    a, b = t.read(), other.read()
    t.publish(a.filter("id < 2"))
    with pytest.raises(dml.ConcurrentUpdate):
        other.publish(b.filter("id > 0"))
    assert rows(other.read()) == [(0,), (1,)]
    (tmp_path / "t" / f"POINTER-{7:012d}").write_text("v-lost")  # a crash before the closing line
    assert rows(t.read()) == [(0,), (1,)]
    t.publish(t.read().filter("id < 1"))
    assert rows(other.read()) == [(0,)] and t.append(spark.range(5, 6)) and other.append(spark.range(6, 7))
    t.vacuum(1)
    assert rows(t.read()) == [(0,), (5,), (6,)]
    t.compact()
    assert len(t.parts()) == 1 and rows(other.read()) == [(0,), (5,), (6,)]


def test_csv_rejects_and_blanks(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('h1,h2\n1,"a,b"\n,x\nzz,y\n3,\n')
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    good, bad = files.read_csv(spark, str(p), schema, skip=1)
    assert rows(good) == rows(spark.createDataFrame([(1, "a,b"), (None, "x"), (3, None)], schema)) and bad.count() == 1
    assert rows(files.read_csv(spark, str(p), schema, skip=1, blank="empty")[0]) == rows(spark.createDataFrame([(1, "a,b"), (0, "x"), (3, "")], schema))
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), schema, max_errors=0)


def test_bulk_loader_reports_bad_rows(spark, tmp_path):
    failed = []
    loader = files.BulkLoader(spark, str(tmp_path / "t"), T.StructType([T.StructField("k", T.IntegerType(), False)]), on_failure=lambda h, f, e: failed.append(h))
    for handle, value in (("a", 1), ("b", "x"), ("c", None), ("d", 2)):
        loader.insert_row(handle, value)
    loader.close()
    assert failed == ["b", "c"] and loader.loaded == 2


def test_upsert_stream_and_export(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, "c")], "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = dml.VersionedTable(spark, str(tmp_path / "t"))
    stream = lambda: incremental.file_stream(spark, str(tmp_path / "in"), "k int, v string")
    incremental.upsert_stream(stream(), t, ["k"], str(tmp_path / "c1")).awaitTermination()
    assert {r[0] for r in rows(t.read())} == {1, 2} and t.read().count() == 2
    incremental.export_stream(stream(), "file", str(tmp_path / "c2"), path=str(tmp_path / "out")).awaitTermination()
    assert spark.read.csv(str(tmp_path / "out")).count() == 3
