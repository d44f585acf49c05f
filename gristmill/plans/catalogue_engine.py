"""Catalogue entries for procedures, generated CRUD, data definition, constraints, rollback, streams into tables and client interfaces."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import logic
from gristmill.operators import dml, views
from gristmill.plans import client
from gristmill.plans.catalogue_state import _folder
from gristmill.plans.ddl import DefinitionError, Schema
from gristmill.plans.procedures import Abort, Engine, convert, expect
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


def outcomes(spark: SparkSession, *cases: tuple[str, Callable[[], object]]) -> DataFrame:
    """One row a case: what it returned, or the kind of its error."""
    rows = []
    for name, run in cases:
        try:
            rows.append((name, str(run())))
        except (Abort, dml.ConstraintViolation, dml.ConcurrentUpdate, DefinitionError, ValueError, TypeError) as e:
            rows.append((name, type(e).__name__))
        except Exception as e:  # an error of the engine at run time
            rows.append((name, "USER_RAISED" if "USER_RAISED_EXCEPTION" in str(e) else type(e).__name__))
    return spark.createDataFrame(rows, "case_name string, outcome string")


def _outcomes_sql(expected: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in expected.items()) + ") AS v(case_name, outcome)"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _stored(spark: SparkSession, df: DataFrame) -> dml.VersionedTable:
    store = dml.VersionedTable(spark, _folder(spark))
    store.publish(df)
    return store


# data access by index and count
@entry("index_scan_reverse", "SELECT 'lt' AS walk, nullif(o_custkey, 11) AS k, o_orderkey FROM orders WHERE nullif(o_custkey, 11) < 40 UNION ALL SELECT 'lte', nullif(o_custkey, 11), o_orderkey FROM orders WHERE nullif(o_custkey, 11) <= 40 AND nullif(o_custkey, 11) > 20 UNION ALL SELECT 'prefix', o_custkey, o_orderkey FROM orders WHERE o_custkey = 40 AND o_orderkey <= 100000")
def _reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse walks from a key downward, open and closed, over a key with NULLs, and within a key prefix."""
    orders = table(spark, sf_dir, "orders").select(F.nullif(F.col("o_custkey"), F.lit(11)).alias("k"), "o_custkey", "o_orderkey")
    walk = lambda name, cond, key="k": orders.filter(cond).orderBy(F.desc(key), F.desc("o_orderkey")).select(F.lit(name).alias("walk"), F.col(key).alias("k"), "o_orderkey")
    return walk("lt", F.col("k") < 40).unionByName(walk("lte", (F.col("k") <= 40) & (F.col("k") > 20))).unionByName(walk("prefix", (F.col("o_custkey") == 40) & (F.col("o_orderkey") <= 100000), "o_custkey"))


@entry("index_lookup_types", "SELECT 'eq' AS walk, count(*) AS n FROM orders WHERE o_custkey = 40 UNION ALL SELECT 'gt', count(*) FROM orders WHERE o_custkey > 40 UNION ALL SELECT 'gte', count(*) FROM orders WHERE o_custkey >= 40 UNION ALL SELECT 'lt', count(*) FROM orders WHERE o_custkey < 40 UNION ALL SELECT 'lte', count(*) FROM orders WHERE o_custkey <= 40 UNION ALL SELECT 'null_key', 0")
def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    conds = {"eq": k == 40, "gt": k > 40, "gte": k >= 40, "lt": k < 40, "lte": k <= 40, "null_key": k == F.lit(None).cast("bigint")}
    counts = table(spark, sf_dir, "orders").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in conds.items()])  # one pass for all
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("walk"), F.col(n).alias("n")) for n in conds])).alias("r")).select("r.*")


@entry("agg_pre_predicate", "SELECT max(o_totalprice) AS top FROM orders WHERE o_orderkey < 3000 AND o_totalprice < 200000")
def _pre_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicate reaches the scan, so MAX sees only rows that pass."""
    return table(spark, sf_dir, "orders").filter("o_orderkey < 3000 AND o_totalprice < 200000").agg(F.max("o_totalprice").alias("top"))


@entry("explain_plan", _outcomes_sql({"pushed filter": "True", "read columns": "True", "scan": "True"}))
def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("explained_orders")
    text = Engine(spark).explain("SELECT o_custkey FROM explained_orders WHERE o_orderkey > 5")
    return outcomes(spark, ("scan", lambda: "Scan parquet" in text), ("pushed filter", lambda: "GreaterThan(o_orderkey,5)" in text), ("read columns", lambda: "struct<o_orderkey:bigint,o_custkey:bigint>" in text.replace("ReadSchema: ", "")))


# rewrites
@entry("crud_procedures", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (3, 4, 5) UNION ALL SELECT 3, 'upserted', 1 UNION ALL SELECT 4, 'updated', 2 UNION ALL SELECT 100, 'inserted', 0")
def _crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, _nation(spark, sf_dir))
    engine = Engine(spark)
    engine.crud("NATION", store, ["n_nationkey"])
    engine.call("NATION.insert", 100, "inserted", 0)
    engine.call("NATION.upsert", 3, "upserted", 1)
    engine.call("NATION.update", 4, "updated", 2, 4)
    engine.call("NATION.delete", 5)
    return store.read()


@entry("crud_select", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
def _crud_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.crud("NATION", _stored(spark, _nation(spark, sf_dir)), ["n_nationkey"])
    return engine.call("NATION.select", 7)


_BROKEN = {"duplicate key": "ConstraintViolation", "null": "ConstraintViolation", "row limit": "ConstraintViolation", "partition column": "ConstraintViolation", "unknown column": "ValueError", "rows after": "25"}


@entry("constraints", _outcomes_sql(_BROKEN))
def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _nation(spark, sf_dir)
    store = _stored(spark, nation)
    twice = dml.insert(nation, nation.filter("n_nationkey = 1"))
    blank = dml.insert(nation, spark.createDataFrame([(77, 1)], "n_nationkey long, n_regionkey long"))
    return outcomes(
        spark,
        ("duplicate key", lambda: store.publish(twice, unique=[["n_nationkey"]])),
        ("null", lambda: store.publish(blank, not_null=["n_name"])),
        ("row limit", lambda: store.publish(nation, row_limit=10)),
        ("partition column", lambda: dml.update(nation, F.lit(True), {"n_nationkey": F.lit(1)}, partition_column="n_nationkey")),
        ("unknown column", lambda: dml.insert(nation, nation.withColumn("more", F.lit(1)))),
        ("rows after", lambda: store.read().count()),
    )


@entry("rollback", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 10")
def _rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that fails a constraint, one that fails half-way, a crash before the pointer is whole and a late writer change nothing."""
    store = _stored(spark, _nation(spark, sf_dir).filter("n_nationkey < 10"))
    late = dml.VersionedTable(spark, store.path)
    late.read()
    rows = store.read()
    attempts = [
        lambda: store.publish(rows.unionByName(rows), unique=[["n_nationkey"]]),
        lambda: store.publish(rows.withColumn("n_name", F.when(F.col("n_nationkey") == 9, F.raise_error(F.lit("half-way"))).otherwise(F.col("n_name")))),
    ]
    for attempt in attempts:
        try:
            attempt()
        except Exception:  # each is meant to fail
            continue
        raise AssertionError("a failing load went through")
    store.publish(rows)  # the same rows as a new version
    try:
        late.publish(rows.limit(0))
        raise AssertionError("a late writer went through")
    except dml.ConcurrentUpdate:
        pass
    fs, at = store._fs(f"{store.path}/POINTER-{999:012d}")
    fs.create(at, False).close()  # what a crash would leave
    return store.read()


@entry("load_procedure", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'again' ELSE n_name END AS n_name, n_regionkey FROM nation")
def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading as one transaction, by insert and by upsert; a broken one changes nothing."""
    nation = _nation(spark, sf_dir)
    store = _stored(spark, nation.filter("n_nationkey < 5"))
    files.load_checked(nation.filter("n_nationkey >= 5"), store, unique=[["n_nationkey"]])
    files.load_checked(nation.filter("n_nationkey < 5").withColumn("n_name", F.lit("again")), store, upsert_key=["n_nationkey"], unique=[["n_nationkey"]])
    try:
        files.load_checked(nation, store, unique=[["n_nationkey"]])
    except dml.ConstraintViolation:
        return store.read()
    raise AssertionError("a repeated key went through")


@entry("partition_row_limit", """
SELECT event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY is_new, ts, event_id) AS rank, sum(1 - is_new) OVER (PARTITION BY user_id % 4) AS had, count(*) OVER (PARTITION BY user_id % 4) AS n
  FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS is_new FROM events) e) x
WHERE rank > CASE WHEN n > 500 THEN least(had, CAST(ceil((n - 500) / 20.0) AS BIGINT) * 20) ELSE 0 END""")
def _partition_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT PARTITION ROWS 500: every partition drops its oldest rows by twenties before new ones come in."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    kept = views.evict_before_insert(events.filter("event_id % 10 <> 0"), events.filter("event_id % 10 = 0"), [F.col("ts"), F.col("event_id")], 500, 20, F.col("user_id") % 4)
    return kept.select("event_id", "user_id")


# procedures
def _reader(context: object, least: int) -> list[DataFrame]:
    context.queue("SELECT count(*) AS n FROM proc_nation WHERE n_nationkey >= :least", "SCALAR_LONG", least=least)
    context.queue("SELECT n_name FROM proc_nation WHERE n_nationkey = :least", "ONE_ROW", least=least)
    return context.execute()


@entry("proc_queue_execute", "SELECT n.n AS n, m.n_name AS n_name FROM (SELECT count(*) AS n FROM nation WHERE n_nationkey >= 20) n, (SELECT n_name FROM nation WHERE n_nationkey = 20) m")
def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statements queued, executed together and checked against their expectations."""
    _nation(spark, sf_dir).createOrReplaceTempView("proc_nation")
    engine = Engine(spark)
    engine.create_procedure("Reader", _reader)
    first, second = engine.call("Reader", 20)
    return first.join(F.broadcast(second))  # one row each


_EXPECTED = {"empty": "[]", "not empty": "Abort", "one row": "Abort", "zero or one": "[]", "scalar": "25", "scalar match": "25", "scalar mismatch": "Abort", "scalar long": "Abort", "abort": "Abort", "unmet": "Abort", "sql error": "USER_RAISED"}


@entry("proc_expectations", _outcomes_sql(_EXPECTED))
def _expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _nation(spark, sf_dir)
    nation.createOrReplaceTempView("proc_nation")
    count, none = nation.agg(F.count(F.lit(1)).alias("n")), nation.filter("n_nationkey < 0")
    engine = Engine(spark)
    engine.create_procedure("Reader", _reader)

    def give_up(_: object) -> None:
        raise Abort("given up")

    engine.create_procedure("GiveUp", give_up)
    return outcomes(
        spark,
        ("empty", lambda: expect(none, "EMPTY")), ("not empty", lambda: expect(none, "NON_EMPTY")), ("one row", lambda: expect(nation, "ONE_ROW")), ("zero or one", lambda: expect(none, "ZERO_OR_ONE_ROW")),
        ("scalar", lambda: expect(count, "SCALAR")), ("scalar match", lambda: expect(count, "SCALAR_MATCH", 25)), ("scalar mismatch", lambda: expect(count, "SCALAR_MATCH", 24)),
        ("scalar long", lambda: expect(nation.filter("n_nationkey = 1").select("n_name"), "SCALAR_LONG")), ("abort", lambda: engine.call("GiveUp")), ("unmet", lambda: engine.call("Reader", 1000)),
        ("sql error", lambda: nation.select(logic.sql_error(1, "stop", F.col("n_nationkey") == 3).alias("x")).collect()),
    )


@entry("proc_determinism", _outcomes_sql({"same seed": "True", "other seed": "False", "unique id": "5"}))
def _determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.create_procedure("Draw", lambda context: [context.random.random() for _ in range(5)])
    engine.create_procedure("Id", lambda context: context.unique_id)
    return outcomes(spark, ("same seed", lambda: engine.call("Draw", seed=5) == engine.call("Draw", seed=5)), ("other seed", lambda: engine.call("Draw", seed=5) == engine.call("Draw", seed=6)), ("unique id", lambda: engine.call("Id", seed=5)))


_CONVERTED = {"tinyint": "127", "tinyint least": "ValueError", "tinyint over": "ValueError", "text": "42", "bad text": "ValueError", "null": "None", "bigint over": "ValueError"}


@entry("proc_parameter_conversion", _outcomes_sql(_CONVERTED))
def _conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda v, kind: spark.range(1).select(convert(v, kind).alias("v")).first()[0]
    return outcomes(
        spark,
        ("tinyint", lambda: value(127, "tinyint")), ("tinyint least", lambda: value(-128, "tinyint")), ("tinyint over", lambda: value(128, "tinyint")), ("text", lambda: value("42", "int")), ("bad text", lambda: value("4x", "int")),
        ("null", lambda: value(None, "bigint")), ("bigint over", lambda: value(1 << 63, "bigint")),
    )


# data definition
_DDL = """
CREATE TABLE contestants (contestant_number INTEGER NOT NULL, contestant_name VARCHAR(50) NOT NULL, CONSTRAINT pk_contestants PRIMARY KEY (contestant_number));
CREATE TABLE votes (phone_number BIGINT NOT NULL, state VARCHAR(2 BYTES) DEFAULT 'XX' NOT NULL, contestant_number INTEGER NOT NULL); -- one row a vote
PARTITION TABLE votes ON COLUMN phone_number;
CREATE INDEX votes_by_state ON votes (state, contestant_number);
CREATE UNIQUE INDEX contestant_names ON contestants (upper(contestant_name));
CREATE VIEW v_votes_by_state (contestant_number, state, num_votes) AS SELECT contestant_number, state, count(*) FROM votes GROUP BY contestant_number, state;
CREATE PROCEDURE Results AS SELECT a.contestant_name, sum(b.num_votes) AS total_votes FROM v_votes_by_state b JOIN contestants a ON a.contestant_number = b.contestant_number WHERE b.state <> ? GROUP BY a.contestant_name;
"""


def _voter(spark: SparkSession, sf_dir: str) -> tuple[Engine, Schema]:
    engine = Engine(spark)
    schema = Schema(engine, _folder(spark))
    schema.run(_DDL)
    schema.table("contestants").load(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("contestant_number"), F.col("r_name").alias("contestant_name")))
    customer = table(spark, sf_dir, "customer")
    schema.table("votes").load(customer.select(F.col("c_custkey").cast("bigint").alias("phone_number"), F.substring("c_mktsegment", 1, 2).alias("state"), (F.col("c_nationkey") % 5).cast("int").alias("contestant_number")))
    return engine, schema


@entry("ddl_procedure_over_view", "SELECT r_name AS contestant_name, count(*) AS total_votes FROM customer JOIN region ON r_regionkey = c_nationkey % 5 WHERE substr(c_mktsegment, 1, 2) <> 'BU' GROUP BY r_name")
def _ddl_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _voter(spark, sf_dir)
    # views and tables are names of the session: read them before another query defines them anew
    return engine.call("Results", "BU")


@entry("ddl_catalogue", "SELECT * FROM (VALUES ('TABLE', 'contestants', NULL, 'contestant_number:int,contestant_name:string'), ('TABLE', 'votes', NULL, 'phone_number:bigint,state:string,contestant_number:int'), ('INDEX', 'votes_by_state', 'votes', 'state,contestant_number'), ('INDEX', 'contestant_names', 'contestants', 'UNIQUE upper(contestant_name)'), ('VIEW', 'v_votes_by_state', NULL, NULL)) AS v(kind, name, of, detail)".replace(" of,", ' "of",'))
def _ddl_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voter(spark, sf_dir)[1].catalogue()


_REFUSED = {"primary key": "ConstraintViolation", "unique expression": "ConstraintViolation", "too long": "ConstraintViolation", "default": "XX", "nullable partition": "DefinitionError", "twice": "DefinitionError", "syntax": "DefinitionError", "dropped": "DefinitionError", "drop if exists": "None"}


@entry("ddl_constraints_and_drop", _outcomes_sql(_REFUSED))
def _ddl_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, schema = _voter(spark, sf_dir)
    contestants, votes = schema.table("contestants"), schema.table("votes")
    row = lambda text, kind: spark.createDataFrame([text], kind)

    def default() -> str:
        votes.load(row((-1, 1), "phone_number long, contestant_number int"))
        return votes.store.read().filter("phone_number = -1").first()["state"]

    def dropped() -> None:
        schema.run("DROP INDEX contestant_names; DROP VIEW v_votes_by_state; DROP PROCEDURE Results; DROP TABLE contestants")
        schema.table("contestants")

    return outcomes(
        spark,
        ("primary key", lambda: contestants.load(row((1, "new"), "contestant_number int, contestant_name string"))),
        ("unique expression", lambda: contestants.load(row((99, "africa"), "contestant_number int, contestant_name string"))),
        ("too long", lambda: votes.load(row((-2, "ABC", 1), "phone_number long, state string, contestant_number int"))),
        ("default", default),
        ("nullable partition", lambda: schema.run("CREATE TABLE loose (x BIGINT); PARTITION TABLE loose ON COLUMN x")),
        ("twice", lambda: schema.run("CREATE TABLE votes (x INTEGER)")),
        ("syntax", lambda: schema.run("CREATE SOMETHING x")),
        ("dropped", dropped),
        ("drop if exists", lambda: schema.run("DROP TABLE nowhere IF EXISTS")),
    )


# streams
@entry("stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user: within a batch the highest event wins, and batches come in order of events."""
    at = _folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    middle = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0] or 0
    for part in (events.filter(F.col("event_id") <= middle), events.filter(F.col("event_id") > middle)):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    target = dml.VersionedTable(spark, f"{at}/table")
    incremental.upsert_stream(incremental.file_stream(spark, f"{at}/in", "user_id long, event_id long"), target, ["user_id"], f"{at}/checkpoint", order="event_id").awaitTermination()
    return target.read()


@entry("stream_export", "SELECT n_nationkey, n_name, CAST(1 AS TINYINT) AS export_op, true AS by_batch FROM nation")
def _export_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    _nation(spark, sf_dir).select("n_nationkey", "n_name").repartition(3, "n_nationkey").write.parquet(f"{at}/in")
    stream = incremental.file_stream(spark, f"{at}/in", "n_nationkey long, n_name string")
    incremental.export_stream(stream, "file", f"{at}/checkpoint", path=f"{at}/out").awaitTermination()
    kinds = "export_transaction long, export_time long, export_sequence long, export_partition int, export_site int, export_op tinyint, n_nationkey long, n_name string"
    got = spark.read.schema(kinds).csv(f"{at}/out")
    return got.select("n_nationkey", "n_name", "export_op", F.col("export_transaction").between(0, 2).alias("by_batch"))


# sources and clients
@entry("csv_skip_and_errors", "SELECT s_suppkey, s_name, CAST(2 AS BIGINT) AS rejected FROM supplier")
def _csv_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of each file are skipped; two lines that do not fit the schema are rejected and counted."""
    supplier, at = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), _folder(spark)
    lines = supplier.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.format_string('"%s"', "s_name")).alias("value"))
    extra = spark.createDataFrame([("key,name",), ("# a remark",), ("x1,bad",), ("x2,bad",)], "value string")
    extra.coalesce(1).unionByName(lines).coalesce(1).write.text(at)
    good, bad = files.read_csv(spark, at, supplier.schema, skip=2, max_errors=2)
    return good.join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("rejected"))))


@entry("csv_strict_quotes_and_limits", _outcomes_sql({"strict quotes": "(1, 2)", "too many errors": "ValueError", "blank error": "(2, 1)", "blank empty": "0", "row limit": "2"}))
def _csv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    at = _folder(spark)
    spark.createDataFrame([('"1","a"',), ("2,b",), ('"","c"',)], "value string").coalesce(1).write.text(at)
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    read = lambda **options: files.read_csv(spark, at, schema, **options)

    def counts(**options: object) -> tuple[int, int]:
        good, bad = read(**options)
        return good.count(), bad.count()

    strict = spark.createDataFrame([('"1","a"',), ("x",), ("y",)], "value string")
    other = _folder(spark)
    strict.coalesce(1).write.text(other)
    return outcomes(
        spark,
        ("strict quotes", lambda: (lambda g: (g[0].count(), g[1].count()))(files.read_csv(spark, other, schema, strict_quotes=True))), ("too many errors", lambda: files.read_csv(spark, other, schema, max_errors=1)),
        ("blank error", lambda: counts(blank="error")), ("blank empty", lambda: read(blank="empty")[0].filter("s = 'c'").first()["n"]), ("row limit", lambda: read(limit=2)[0].count()),
    )


@entry("snapshot_to_csv", "SELECT n_nationkey, n_name FROM nation")
def _snapshot_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    files.snapshot_save({"nation": _nation(spark, sf_dir)}, at, "first")
    files.snapshot_to_csv(spark, at, "first", "nation", f"{at}/csv")
    return spark.read.schema("n_nationkey long, n_name string, n_regionkey long").option("header", "true").csv(f"{at}/csv").select("n_nationkey", "n_name")


@entry("http_json_call", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure called over HTTP; the rows are those of the JSON answer (5 at any scale)."""
    _nation(spark, sf_dir).createOrReplaceTempView("http_nation")
    engine = Engine(spark)
    engine.create_procedure("ByRegion", "SELECT n_name, n_regionkey FROM http_nation WHERE n_regionkey = :region")
    with client.Server(engine) as server:
        body = urllib.parse.urlencode({"Procedure": "ByRegion", "Parameters": json.dumps({"region": 2})}).encode()
        answer = json.load(urllib.request.urlopen(urllib.request.Request(server.url, data=body), timeout=60))
        refused = json.load(urllib.request.urlopen(f"{server.url}?Procedure=None", timeout=60))
    if answer["status"] != 1 or refused["status"] >= 0:
        raise AssertionError(answer["statusstring"])
    return spark.createDataFrame([tuple(r) for r in answer["results"][0]["data"]], "n_name string, n_regionkey long")


@entry("dbapi_cursor", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _dbapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared statement through a DB-API connection, its rows fetched one, some and all (5 at any scale)."""
    _nation(spark, sf_dir).createOrReplaceTempView("dbapi_nation")
    cursor = client.connect(Engine(spark)).cursor()
    cursor.execute("SELECT n_nationkey, n_name FROM dbapi_nation WHERE n_regionkey = :region", {"region": 1})
    kinds = ", ".join(f"{d[0]} {d[1]}" for d in cursor.description)
    rows = [cursor.fetchone(), *cursor.fetchmany(2), *cursor.fetchall()]
    return spark.createDataFrame(rows, kinds)


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@entry("jdbc_roundtrip", "SELECT n_nationkey, n_name FROM nation")
def _jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export to a table over JDBC and a parallel read of it; the database is one in the driver's memory (25 rows at any scale)."""
    import uuid

    url = f"jdbc:derby:memory:g{uuid.uuid4().hex};create=true"
    upper = _nation(spark, sf_dir).select(F.col("n_nationkey").alias("N_NATIONKEY"), F.col("n_name").alias("N_NAME"))
    files.export(upper, "jdbc", url=url, dbtable="NATION", driver=DERBY, createTableColumnTypes="N_NAME VARCHAR(100)")
    got = files.read_jdbc(spark, url, "NATION", column="N_NATIONKEY", bounds=(0, 25), partitions=4, driver=DERBY)
    return got.select(F.col("N_NATIONKEY").alias("n_nationkey"), F.col("N_NAME").alias("n_name"))
