"""Named procedures over parameterised SQL, with expectations, generated CRUD and a small engine facade."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import dml


class Abort(RuntimeError):
    """Raised by a procedure to give up; nothing is published."""


def expect(df: DataFrame, kind: str, value: object = None) -> object:
    """Check the shape of a result: EMPTY, ONE_ROW, ZERO_OR_ONE_ROW, NON_EMPTY, SCALAR, SCALAR_LONG, SCALAR_MATCH."""
    rows = df.limit(2).collect()
    if kind == "EMPTY" and not rows or kind == "NON_EMPTY" and rows or kind == "ZERO_OR_ONE_ROW" and len(rows) < 2:
        return rows
    if kind == "ONE_ROW" and len(rows) == 1:
        return rows[0]
    if kind.startswith("SCALAR") and len(rows) == 1 and len(rows[0]) == 1:
        found = rows[0][0]
        if kind == "SCALAR" or kind == "SCALAR_LONG" and isinstance(found, int) or kind == "SCALAR_MATCH" and found == value:
            return found
    raise Abort(f"expected {kind}{'' if value is None else f' {value}'}")


def convert(value: object, kind: str) -> Column:
    """A parameter as a literal of a type; values out of the type's range are refused."""
    ranges = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}
    if kind in ranges and value is not None:
        if isinstance(value, str):
            value = int(value)
        # the least value of each integer type stands for NULL
        if not -(1 << ranges[kind]) < value < 1 << ranges[kind]:
            raise ValueError(f"{value} is out of range for {kind}")
    return F.lit(value).cast(kind)


class Context:
    """What a procedure sees: queued statements, its time and a seeded random generator."""

    def __init__(self, spark: SparkSession, seed: int, at: float):
        self.spark, self.unique_id, self.at = spark, seed, at
        self.random = random.Random(seed)
        self.queued: list[tuple[str, dict, str | None]] = []

    def queue(self, sql: str, expectation: str | None = None, **args: object) -> None:
        self.queued.append((sql, args, expectation))

    def execute(self) -> list[DataFrame]:
        """One frame for each queued statement, lazily; statements with an expectation are checked."""
        out = []
        for sql, args, expectation in self.queued:
            df = self.spark.sql(sql, args=args)
            if expectation:
                expect(df, expectation)
            out.append(df)
        self.queued = []
        return out


class Engine:
    """Tables as views of a session, procedures by name, plans and catalog information."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.procedures: dict[str, Callable[..., object]] = {}

    def sql(self, text: str, **args: object) -> DataFrame:
        return self.spark.sql(text, args=args)

    def create_procedure(self, name: str, body: str | Callable[..., object]) -> None:
        """A single statement with :named parameters, or a callable (context, *args)."""
        if isinstance(body, str):
            self.procedures[name] = lambda context, **args: context.spark.sql(body, args=args)
        else:
            self.procedures[name] = body

    def drop_procedure(self, name: str) -> None:
        del self.procedures[name]

    def call(self, name: str, *args: object, seed: int | None = None, **named: object) -> object:
        now = time.time()
        return self.procedures[name](Context(self.spark, int(now * 1000) if seed is None else seed, now), *args, **named)

    def crud(self, name: str, table: dml.VersionedTable, key: list[str], after: Callable[[], object] | None = None) -> None:
        """<name>.insert, .upsert, .update, .delete and .select over a table with a key; ``after`` runs once a change is out."""

        def publish(df: DataFrame, **constraints: object) -> None:
            table.publish(df, **constraints)
            if after is not None:
                after()

        def rows(values: tuple) -> DataFrame:
            return self.spark.createDataFrame([values], table.read().schema)

        def matches(values: tuple) -> Column:
            cond = F.lit(True)
            for k, v in zip(key, values):
                cond = cond & (F.col(k) == F.lit(v))
            return cond

        def insert(_: Context, *values: object) -> None:
            publish(dml.insert(table.read(), rows(values)), unique=[key])

        def upsert(_: Context, *values: object) -> None:
            publish(dml.upsert(table.read(), rows(values), key))

        def update(_: Context, *values: object) -> None:
            columns = table.read().columns
            changes = {c: F.lit(v) for c, v in zip(columns, values) if c not in key}
            publish(dml.update(table.read(), matches(values[len(columns) :]), changes))

        def delete(_: Context, *values: object) -> None:
            publish(dml.delete(table.read(), matches(values)))

        def select(_: Context, *values: object) -> DataFrame:
            return table.read().filter(matches(values))

        for f in (insert, upsert, update, delete, select):
            self.procedures[f"{name}.{f.__name__}"] = f

    def explain(self, text: str, **args: object) -> str:
        return self.spark.sql(text, args=args)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def catalog(self, what: str = "tables") -> DataFrame:
        """tables or columns of the session's catalog."""
        names = [t.name for t in self.spark.catalog.listTables()]
        if what == "tables":
            return self.spark.createDataFrame([(n,) for n in names], "table_name string")
        found = [(n, c.name, c.dataType, c.nullable) for n in names for c in self.spark.catalog.listColumns(n)]
        return self.spark.createDataFrame(found, "table_name string, column_name string, type_name string, nullable boolean")

    def statistics(self, names: list[str]) -> DataFrame:
        """Row counts of tables, one aggregate each."""
        out = None
        for n in names:
            one = self.spark.table(n).agg(F.count(F.lit(1)).alias("tuple_count")).select(F.lit(n).alias("table_name"), "tuple_count")
            out = one if out is None else out.unionByName(one)
        return out
