"""INSERT, UPSERT, UPDATE, DELETE and TRUNCATE as table rewrites, and atomic publication of versions.

A statement maps a table to a new table; ``VersionedTable`` publishes it as a new directory and moves a pointer
to it last, so readers see the old or the new version and a failure changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ConstraintViolation(ValueError):
    """A table rewrite that would break a constraint."""


def _filled(target: DataFrame, rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """rows with the target's columns: missing ones take defaults, else NULL."""
    extra = set(rows.columns) - set(target.columns)
    if extra:
        raise ValueError(f"unknown columns: {sorted(extra)}")
    value = lambda f: F.col(f.name) if f.name in rows.columns else (defaults[f.name] if isinstance(defaults.get(f.name), Column) else F.lit(defaults.get(f.name)))
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    return target.unionByName(_filled(target, rows, defaults or {}))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], defaults: dict[str, object] | None = None, order: str | None = None) -> DataFrame:
    """Insert or replace by key; columns that are not given take defaults. Of several rows with one key the last
    by ``order`` wins (without an order, one of them). The ranked window has a group limit, so a hot key's rows
    are cut to one before the shuffle."""
    new = rows
    if order is not None:
        last = Window.partitionBy(*key).orderBy(F.desc(order))
        new = rows.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank", *([] if order in target.columns else [order]))
    else:
        new = rows.dropDuplicates(key)
    new = _filled(target, new, defaults or {})
    return target.join(new.select(*key), key, "left_anti").unionByName(new)


def update(target: DataFrame, cond: Column, changes: dict[str, Column], partition_column: str | None = None) -> DataFrame:
    """Rows where cond is TRUE get the changes; all values are read before any is written."""
    if partition_column in changes:
        raise ConstraintViolation("the partition column of a row cannot change")
    true = F.coalesce(cond, F.lit(False))
    return target.select(*[F.when(true, changes[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f.name) for f in target.schema.fields])


def delete(target: DataFrame, cond: Column | None = None) -> DataFrame:
    """Rows where cond is TRUE go; NULL keeps."""
    return target.limit(0) if cond is None else target.filter(~F.coalesce(cond, F.lit(False)))


def delete_ordered(target: DataFrame, key: list[str], order: list[Column], limit: int, offset: int = 0, cond: Column | None = None) -> DataFrame:
    """DELETE ... ORDER BY ... LIMIT: the order is to be total."""
    if not order:
        raise ValueError("DELETE with LIMIT needs ORDER BY")
    chosen = (target if cond is None else target.filter(cond)).orderBy(*order).offset(offset).limit(limit).select(*key)
    return target.join(chosen, key, "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def check(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), row_limit: int | None = None) -> None:
    """Raise ConstraintViolation where a constraint fails: one aggregate for NULLs and rows, one for each key."""
    wanted = [F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{i}") for i, c in enumerate(not_null)]]
    got = df.agg(*wanted).first()
    for i, c in enumerate(not_null):
        if got[f"null_{i}"]:
            raise ConstraintViolation(f"NULL in {c}")
    if row_limit is not None and got["n"] > row_limit:
        raise ConstraintViolation(f"more than {row_limit} rows")
    for key in unique:
        if not df.groupBy(*[F.expr(k) for k in key]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            raise ConstraintViolation(f"repeated key {key}")


class ConcurrentUpdate(RuntimeError):
    """Another writer published a version since this one read the table."""


class VersionedTable:
    """A table as immutable parts and numbered pointer files, the highest of which names the current parts.

    A rewrite publishes one new part in place of all; an append adds a part and rewrites nothing. A part may be
    named, so that a batch that is tried again is added once. A version is published by creating its pointer file, which
    must not be there yet: two writers cannot both take a number, so no update is lost, and nothing is ever
    deleted first, so a crash at any step leaves the last version in place. A pointer without its closing line was left by
    a crash and is passed over.
    """

    _END = "end of pointer"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._base: int | None = None

    def _fs(self, path: str) -> tuple:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf), at

    def _names(self) -> list[str]:
        fs, at = self._fs(self.path)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted((int(n[8:]) for n in self._names() if n.startswith("POINTER-")), reverse=True)

    def _listed(self, number: int) -> list[str] | None:
        lines = [r[0] for r in self.spark.read.text(f"{self.path}/POINTER-{number:012d}").collect()]  # a line for each part
        return lines[:-1] if lines and lines[-1] == self._END else None

    def current(self) -> tuple[int, list[str]]:
        """Number and parts of the current version; (0, []) before the first."""
        for number in self._numbers():
            parts = self._listed(number)
            if parts is not None:
                return number, parts
        return 0, []

    def parts(self) -> list[str]:
        """Names of the current parts; none before the first publication."""
        return self.current()[1]

    def exists(self) -> bool:
        return bool(self.parts())

    def read(self) -> DataFrame:
        self._base, parts = self.current()
        if not parts:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])

    def _point(self, base: int, parts: list[str]) -> int:
        """Publish parts as the successor of a version; ConcurrentUpdate if there is one already."""
        taken = self._numbers()
        number = max([base, *taken]) + 1
        if any(n > base and self._listed(n) is not None for n in taken):
            raise ConcurrentUpdate(f"{self.path} has a version after {base}")
        fs, at = self._fs(f"{self.path}/POINTER-{number:012d}")
        try:
            out = fs.create(at, False)
        except Exception as e:
            raise ConcurrentUpdate(f"{self.path} has a version after {base}") from e
        out.write(bytearray("\n".join([*parts, self._END]).encode()))
        out.close()
        return number

    def publish(self, df: DataFrame, **constraints: object) -> None:
        """Replace the table: write a new part, check it, and only then point to it.

        The new version follows the one last read through this object; if another writer came between, it is refused.
        """
        part = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        if constraints:
            check(self.spark.read.parquet(f"{self.path}/{part}"), **constraints)
        self._base = self._point(self.current()[0] if self._base is None else self._base, [part])

    def append(self, df: DataFrame, name: str | None = None) -> bool:
        """Add a part; False if a part of that name is there already. Appends of several writers all count."""
        part = name or f"v-{uuid.uuid4().hex}"
        base, have = self.current()
        if part in have:
            return False
        df.write.mode("overwrite").parquet(f"{self.path}/{part}")  # what a failed try left behind goes
        while True:
            try:
                self._base = self._point(base, [*have, part])
                return True
            except ConcurrentUpdate:
                base, have = self.current()
                if part in have:
                    return False

    def compact(self) -> None:
        """Write the parts of a table that has grown by appends as one."""
        self.publish(self.read())

    def vacuum(self, keep: int = 2) -> None:
        """Remove the versions before the last ``keep`` and the parts that only they name."""
        numbers = self._numbers()
        kept = {p for n in numbers[:keep] for p in self._listed(n) or []}
        gone = [f"POINTER-{n:012d}" for n in numbers[keep:]]
        named = {p for n in numbers[keep:] for p in self._listed(n) or []}
        for name in [*gone, *sorted(named - kept)]:
            fs, at = self._fs(f"{self.path}/{name}")
            fs.delete(at, True)

    def drop(self) -> None:
        fs, at = self._fs(self.path)
        fs.delete(at, True)
