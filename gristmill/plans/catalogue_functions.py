"""Catalogue entries for scalar functions, typing rules and the operators' own helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import dates, jsons, logic, numbers, strings
from gristmill.operators import joins, relational
from gristmill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def project(name: str, source: str, keys: list[str], columns: dict[str, tuple[Column | Callable[[], Column], str | None]]) -> None:
    """A projection of a table: each column as a helper's Column (built when run) and as DuckDB SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*keys, *[(c() if callable(c) else c).alias(k) for k, (c, _) in columns.items()])

    QUERIES[name] = run
    if all(sql for _, sql in columns.values()):
        ORACLE_SQL[name] = f"SELECT {', '.join([*keys, *(f'{sql} AS {k}' for k, (_, sql) in columns.items())])} FROM {source}"


def entry(name: str, sql: str | None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


C = lambda name: F.col(name)
PART, EVENTS, ORDERS = ["p_partkey"], ["event_id"], ["o_orderkey"]

# strings
project("fn_octet_length", "part", PART, {"v": (lambda: strings.octet_length(F.concat(C("p_name"), F.lit("é"))), "CAST(octet_length(encode(p_name || 'é')) AS BIGINT)")})
project("fn_char", "part", PART, {"v": (lambda: strings.char(C("p_size") + 8300), "chr(p_size + 8300)")})
project("fn_char_length", "part", PART, {"v": (lambda: strings.char_length(F.concat(C("p_name"), F.lit("é"))), "CAST(length(p_name || 'é') AS BIGINT)")})
project("fn_space", "part", PART, {"v": (lambda: F.concat(F.lit("<"), strings.space(C("p_size") % 4), F.lit(">")), "'<' || repeat(' ', CAST(p_size % 4 AS BIGINT)) || '>'")})
project("fn_lower_upper", "part", PART, {"lo": (lambda: strings.lower(F.concat(C("p_type"), F.lit("É"))), "lower(p_type) || 'É'"), "up": (lambda: strings.upper(F.concat(C("p_name"), F.lit("é"))), "upper(p_name) || 'é'")})
project("fn_repeat", "part", PART, {"v": (lambda: strings.repeat(C("p_brand"), C("p_size") % 3), "repeat(p_brand, CAST(p_size % 3 AS BIGINT))")})
project("fn_position", "part", PART, {"v": (lambda: strings.position("an", C("p_name")), "CAST(position('an' IN p_name) AS BIGINT)")})
project("fn_left_right", "part", PART, {"l": (lambda: strings.left(C("p_name"), C("p_size") % 6), "left(p_name, CAST(p_size % 6 AS BIGINT))"), "r": (lambda: strings.right(C("p_name"), C("p_size") % 6), "CASE WHEN p_size % 6 = 0 THEN '' ELSE right(p_name, CAST(p_size % 6 AS BIGINT)) END")})
project("fn_concat", "part", PART, {"v": (lambda: strings.concat(C("p_brand"), "-", C("p_name")), "p_brand || '-' || p_name"), "n": (lambda: strings.concat(C("p_brand"), F.nullif(C("p_size"), F.lit(1)).cast("string")), "p_brand || CAST(nullif(p_size, 1) AS VARCHAR)")})
project("fn_concat_empty_null", "part", PART, {"v": (lambda: strings.concat(strings.left(C("p_name"), 0), F.when(C("p_size") > 25, "").otherwise("x")), "nullif(CASE WHEN p_size > 25 THEN '' ELSE 'x' END, '')")})
project("fn_substring_from", "part", PART, {"v": (lambda: strings.substring(C("p_name"), C("p_size") % 7 - 2), "substring(p_name, greatest(p_size % 7 - 2, 1))")})
project("fn_substring_from_for", "part", PART, {"v": (lambda: strings.substring(C("p_name"), C("p_size") % 7 - 2, 4), "CASE WHEN 4 + least(p_size % 7 - 3, 0) <= 0 THEN '' ELSE substring(p_name, greatest(p_size % 7 - 2, 1), 4 + least(p_size % 7 - 3, 0)) END")})
project("fn_trim", "part", PART, {"b": (lambda: strings.trim(F.concat(F.lit("  "), C("p_name"), F.lit(" "))), "p_name"), "l": (lambda: strings.trim(F.concat(F.lit("  "), C("p_brand"), F.lit(" ")), " ", "leading"), "p_brand || ' '")})
project("fn_trim_string", "part", PART, {"v": (lambda: strings.trim(F.concat(F.lit("ababa"), C("p_brand"), F.lit("babab")), "ab"), "'a' || p_brand || 'b'"), "t": (lambda: strings.trim(F.concat(C("p_brand"), F.lit("xyxy")), "xy", "trailing"), "p_brand")})
project("fn_replace", "part", PART, {"v": (lambda: strings.replace(C("p_name"), "a", "<>"), "replace(p_name, 'a', '<>')")})
project("fn_overlay", "part", PART, {"v": (lambda: strings.overlay(C("p_brand"), "XY", 2, 3), "left(p_brand, 1) || 'XY' || substring(p_brand, 5)"), "d": (lambda: strings.overlay(C("p_brand"), "XY", 3), "left(p_brand, 2) || 'XY' || substring(p_brand, 5)")})
project("fn_format_currency", "part", PART, {"v": (lambda: strings.format_currency(C("p_retailprice") * 1000, 2), "format('{:,.2f}', p_retailprice * 1000)")})
project("fn_like_escape", "part", PART, {"v": (lambda: strings.like(F.concat(C("p_brand"), F.lit("_%")), "%!_!%", "!"), "(p_brand || '_%') LIKE '%!_!%' ESCAPE '!'")})

# numbers
project("fn_abs", "customer", ["c_custkey"], {"v": (lambda: numbers.absolute(C("c_acctbal")), "abs(c_acctbal)")})
project("fn_floor_ceiling_types", "customer", ["c_custkey"], {"f": (lambda: numbers.floor(C("c_acctbal"), "double"), "floor(c_acctbal)"), "c": (lambda: numbers.ceiling(C("c_acctbal"), "double"), "ceil(c_acctbal)")})
project("fn_sqrt", "part", PART, {"v": (lambda: F.round(numbers.sqrt(C("p_retailprice")), 9), "round(sqrt(p_retailprice), 9)")})
project("fn_exp", "part", PART, {"v": (lambda: F.round(numbers.exp(C("p_size") / 10.0), 6), "round(exp(p_size / 10.0), 6)")})
project("fn_power", "part", PART, {"v": (lambda: numbers.power(C("p_size"), F.lit(2)), "power(CAST(p_size AS DOUBLE), 2)")})
project("int_division", "part", PART, {"v": (lambda: numbers.int_div(C("p_size") - 25, F.lit(4)), "CAST((p_size - 25) // 4 AS BIGINT)")})
project("narrow_int_promotion", "part", PART, {"v": (lambda: numbers.promote(C("p_size").cast("tinyint")) * numbers.promote(F.lit(1000000000)), "CAST(p_size AS BIGINT) * 1000000000")})
project("decimal_add", "part", PART, {"v": (lambda: (numbers.as_decimal(C("p_retailprice")) + numbers.as_decimal(F.lit(1).cast("decimal(38,12)"))).cast("double"), "CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 1 AS DOUBLE)")})
project("decimal_multiply", "part", PART, {"v": (lambda: numbers.decimal_multiply(numbers.as_decimal(C("p_size")), F.lit("0.333333333333").cast("decimal(38,12)")).cast("string"), "CAST(CAST(CAST(p_size AS HUGEINT) * 333333333333 AS DECIMAL(38,0)) * CAST(0.000000000001 AS DECIMAL(13,12)) AS VARCHAR)")})
project("decimal_divide", "part", PART, {"v": (lambda: (numbers.decimal_divide(numbers.as_decimal(C("p_size")), numbers.as_decimal(F.lit(7))) * F.lit(10**12)).cast("bigint"), "CAST((CAST(p_size AS HUGEINT) * 1000000000000) // 7 AS BIGINT)")})
project("nan_comparison", "part", PART, {"v": (lambda: numbers.true_comparison(F.when(C("p_size") > 25, F.lit(float("nan"))).otherwise(1.0) >= 0.5, F.when(C("p_size") > 25, F.lit(float("nan"))).otherwise(1.0)), "p_size <= 25")})
project("not_in_list_nulls", "part", PART, {"v": (lambda: ~numbers.in_list(C("p_size"), [1, None, 3]), "p_size NOT IN (1, 3)")})

# dates
for _field, _sql in {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "day_of_week": "dayofweek(ts) + 1", "weekday": "isodow(ts) - 1", "week_of_year": "week(ts)", "day_of_year": "dayofyear(ts)", "quarter": "quarter(ts)", "hour": "hour(ts)", "minute": "minute(ts)",
}.items():
    project(f"fn_extract_{_field}", "events", EVENTS, {"v": ((lambda f=_field: dates.extract(f, C("ts")).cast("bigint")), f"CAST({_sql} AS BIGINT)")})
project("fn_extract_second", "events", EVENTS, {"v": (lambda: (dates.extract("SECOND", C("ts")) * 1000000).cast("bigint"), "CAST(epoch_us(ts) % 60000000 AS BIGINT)")})
for _unit, _per in (("second", 1_000_000), ("millis", 1_000), ("micros", 1)):
    project(f"fn_since_epoch_{_unit}", "events", EVENTS, {"v": ((lambda u=_unit: dates.since_epoch(u, C("ts"))), f"CAST(epoch_us(ts) // {_per} AS BIGINT)")})
    project(f"fn_to_timestamp_{_unit}", "events", EVENTS, {"v": ((lambda u=_unit, p=_per: dates.to_timestamp(u, C("event_id") * F.lit(1_000_000_000_000 // p))), "make_timestamp(event_id * 1000000000000)")})
project("fn_since_epoch_negative", "events", EVENTS, {"v": (lambda: dates.since_epoch("SECOND", dates.to_timestamp("MICROS", -C("event_id") * 300_001)), "CAST(-((event_id * 300001) // 1000000) AS BIGINT)")})
project("fn_from_unixtime", "events", EVENTS, {"v": (lambda: dates.from_unixtime(C("event_id") * 86_401), "make_timestamp(event_id * 86401 * 1000000)")})
for _unit in ("year", "quarter", "month", "day", "hour", "minute", "second", "millisecond", "microsecond"):
    project(f"fn_truncate_{_unit}", "events", EVENTS, {"v": ((lambda u=_unit: dates.truncate(u, C("ts"))), f"CAST(date_trunc('{_unit}', ts) AS TIMESTAMP)")})

# JSON and logic
_DOC = "'{\"a\":{\"b\":[10,20,' || event_id || ']},\"s\":\"x\"}'"
_doc = lambda: F.concat(F.lit('{"a":{"b":[10,20,'), C("event_id").cast("string"), F.lit(']},"s":"x"}'))
project("fn_field", "events", EVENTS, {"k": (lambda: jsons.field(C("props"), "k"), "json_extract_string(props, '$.k')"), "b": (lambda: jsons.field(_doc(), "a.b[2]"), "CAST(event_id AS VARCHAR)"), "none": (lambda: jsons.field(_doc(), "a.c"), "CAST(NULL AS VARCHAR)")})
project("fn_field_tail", "events", EVENTS, {"v": (lambda: jsons.field(_doc(), "a.b[-1]"), "CAST(event_id AS VARCHAR)")})
project("fn_array_element", "events", EVENTS, {"v": (lambda: jsons.array_element(jsons.field(_doc(), "a.b"), (C("event_id") % 4).cast("int")), "CASE event_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '20' WHEN 2 THEN CAST(event_id AS VARCHAR) END")})
project("fn_array_length", "events", EVENTS, {"v": (lambda: jsons.array_length(jsons.field(_doc(), "a.b")), "CAST(3 AS INTEGER)"), "n": (lambda: jsons.array_length(_doc()), "CAST(NULL AS INTEGER)")})
project("fn_set_field", "events", EVENTS, {"v": (lambda: jsons.set_field(_doc(), "a.b[-1]", F.lit("7")), "'{\"a\":{\"b\":[10,20,' || event_id || ',7]},\"s\":\"x\"}'")})
project("fn_decode", "orders", ORDERS, {"v": (lambda: logic.decode(F.nullif(C("o_orderstatus"), F.lit("P")), "F", "done", None, "part", "open"), "CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'part' ELSE 'open' END"), "n": (lambda: logic.decode(C("o_orderstatus"), "F", 1), "CASE WHEN o_orderstatus = 'F' THEN 1 END")})
project("fn_sql_error_passes", "orders", ORDERS, {"v": (lambda: logic.sql_error(1, "never", C("o_orderkey") < 0), "CAST(0 AS BIGINT)")})


@entry("fn_now", "SELECT r_regionkey, now() > TIMESTAMP '2000-01-01 00:00:00' AS later, true AS on_the_clock, 1 AS readings FROM region")
def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading a statement, within a minute of the client's clock."""
    import time

    seconds = dates.since_epoch("SECOND", dates.now())
    region = table(spark, sf_dir, "region").select("r_regionkey", dates.now().alias("at"), (F.abs(seconds - F.lit(int(time.time()))) < 600).alias("on_the_clock"))
    readings = region.select(F.count_distinct("at").cast("int").alias("readings"))
    return region.join(F.broadcast(readings)).select("r_regionkey", (F.col("at") > F.lit("2000-01-01").cast("timestamp")).alias("later"), "on_the_clock", "readings")


@entry("avg_integer_truncates", "SELECT o_orderstatus, CAST(sum(o_custkey - 40) AS BIGINT) // count(*) AS v FROM orders GROUP BY o_orderstatus")
def _avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(numbers.avg_as(F.col("o_custkey") - 40, T.LongType()).alias("v"))


@entry("agg_avg_distinct", "SELECT l_returnflag, CAST(sum(DISTINCT l_suppkey) AS BIGINT) // count(DISTINCT l_suppkey) AS v FROM lineitem GROUP BY l_returnflag")
def _avg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(numbers.avg_as(F.col("l_suppkey"), T.LongType(), distinct=True).alias("v"))


@entry("agg_avg_empty", "SELECT CAST(NULL AS BIGINT) AS v, CAST(0 AS BIGINT) AS n")
def _avg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey < 0").agg(numbers.avg_as(F.col("o_custkey"), T.LongType()).alias("v"), F.count("*").alias("n"))


@entry("group_pk_passthrough", "SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = joins.left_outer(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return relational.group_by_key(joined, ["c_custkey"], [F.count("o_orderkey").alias("n")], ["c_name"])


@entry("in_list_scan", "SELECT v.value, count(p_partkey) AS n FROM (VALUES (1), (5), (9)) AS v(value) LEFT JOIN part ON p_size = v.value GROUP BY v.value")
def _in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = relational.in_list_scan(spark, [9, 1, 5, 1, None, 9], "int")
    return wanted.join(table(spark, sf_dir, "part"), F.col("p_size") == F.col("value"), "left").groupBy("value").agg(F.count("p_partkey").alias("n"))


@entry("count_range", "SELECT count(*) AS n FROM orders WHERE nullif(o_custkey, 11) > 5 AND nullif(o_custkey, 11) <= 60")
def _count_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "orders").select(F.nullif(F.col("o_custkey"), F.lit(11)).alias("k"))
    return relational.count_range(keyed, "k", 5, 60, low_open=True)


@entry("join_range", "SELECT p_partkey, b.lo FROM part JOIN (SELECT CAST(n_nationkey * 80 + 900 AS DOUBLE) AS lo, CAST(n_nationkey * 80 + 1000 AS DOUBLE) AS hi FROM nation) b ON p_retailprice BETWEEN b.lo AND b.hi")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 80.0 + 900).alias("lo"), (F.col("n_nationkey") * 80.0 + 1000).alias("hi"))
    return joins.range_join(table(spark, sf_dir, "part"), ranges, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo")


@entry("join_salted", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus")
def _salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    return joins.salted(orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


for _kind, _hint in (("nested_loop", "broadcast"), ("hash", "shuffle_hash"), ("index", "merge")):

    @entry(f"join_strategy_{_kind}", "SELECT n_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey")
    def _strategy(spark: SparkSession, sf_dir: str, hint: str = _hint) -> DataFrame:
        nation = table(spark, sf_dir, "nation").hint(hint)  # 25 rows at any scale
        return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"))


_M = "4294967295"  # arithmetic modulo 2^32
_ROTL = lambda x, r: f"((({x}) << {r}) & {_M} | (({x}) >> {32 - r}))"
_MUL = lambda x, y: f"((({x}) * CAST({y} AS UBIGINT)) & {_M})"


def _murmur3_sql(key: str, rows: str) -> str:
    """A key and the Murmur3 hash (32 bits, seed 42) of its 64-bit value, as rows (k, h)."""
    steps = [f"s0 AS (SELECT {key} AS k, CAST({key} AS UBIGINT) & {_M} AS lo, CAST({key} AS UBIGINT) >> 32 AS hi, CAST(42 AS UBIGINT) AS h FROM {rows})"]
    at = 0

    def step(h: str) -> None:
        nonlocal at
        steps.append(f"s{at + 1} AS (SELECT k, lo, hi, CAST({h} AS UBIGINT) AS h FROM s{at})")
        at += 1

    for word in ("lo", "hi"):
        mixed = _MUL(_ROTL(_MUL(word, 3432918353), 15), 461845907)
        step(f"xor(h, {mixed})")
        step(f"({_MUL(_ROTL('h', 13), 5)} + 3864292196) & {_M}")
    step("xor(h, CAST(8 AS UBIGINT))")
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        step(_MUL(f"xor(h, h >> {shift})", factor))
    step("xor(h, h >> 16)")
    return f"WITH {', '.join(steps)} SELECT k, CAST(CASE WHEN h >= 2147483648 THEN CAST(h AS BIGINT) - 4294967296 ELSE CAST(h AS BIGINT) END AS BIGINT) AS h FROM s{at}"


@entry("hash_range", f"SELECT k AS c_custkey FROM ({_murmur3_sql('c_custkey', 'customer')}) WHERE h BETWEEN -2147483648 AND 0")
def _hash_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.key_hash_range(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint")), "c_custkey", -(2**31), 0).select("c_custkey")
