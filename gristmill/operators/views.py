"""Aggregate views: batch definition, incremental maintenance under inserts and deletes, retention.

A view groups one source by expressions and keeps COUNT(*), and SUM, COUNT, MIN and MAX of columns. Inserts and
deletes arrive as rows with a sign. Counts and sums merge as signed deltas; MIN and MAX merge under inserts, so a batch
of inserts never reads the source. Groups that lose a row are recomputed, from the source rows of those groups only: the
keys filter the source before it is aggregated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class View:
    """keys: name -> expression; measures: name -> (sum|count|min|max, column); where: an optional filter."""

    keys: dict[str, Column]
    measures: dict[str, tuple[str, str]] = field(default_factory=dict)
    where: Column | None = None
    count: str = "n"

    def _rows(self, source: DataFrame) -> DataFrame:
        rows = source if self.where is None else source.filter(self.where)
        return rows.withColumns({f"_k_{k}": e for k, e in self.keys.items()})

    def batch(self, source: DataFrame) -> DataFrame:
        """The view over the whole source; also the catch-up on creation."""
        return self._grouped(self._rows(source))

    def _grouped(self, rows: DataFrame) -> DataFrame:
        build = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        grouped = rows.groupBy(*[F.col(f"_k_{k}").alias(k) for k in self.keys])
        return grouped.agg(F.count(F.lit(1)).alias(self.count), *[build[f](c).alias(m) for m, (f, c) in self.measures.items()])

    def merge(self, view: DataFrame, changes: DataFrame, source_after: DataFrame | None = None, sign: str = "op") -> DataFrame:
        """The view after ``changes``: source rows with a sign column of 1 (insert) or -1 (delete).

        Without ``source_after`` the changes are inserts only; a delete among them raises.
        """
        keys = list(self.keys)
        op = F.col(sign)
        delta = self._rows(changes).groupBy(*[F.col(f"_k_{k}").alias(k) for k in keys])
        parts = [F.sum(op).alias("_d_rows"), F.min(op).alias("_d_least")]
        for m, (f, c) in self.measures.items():
            x = F.col(c)
            if f == "sum":
                parts += [F.sum(x * op).alias(f"_d_{m}"), F.sum(F.when(x.isNotNull(), op)).alias(f"_c_{m}")]
            elif f == "count":
                parts.append(F.coalesce(F.sum(F.when(x.isNotNull(), op)), F.lit(0)).alias(f"_d_{m}"))
            else:
                parts.append((F.min if f == "min" else F.max)(F.when(op > 0, x)).alias(f"_d_{m}"))
        delta = delta.agg(*parts)
        same = None
        for k in keys:
            one = F.col(f"v.{k}").eqNullSafe(F.col(f"d.{k}"))
            same = one if same is None else same & one
        both = view.alias("v").join(delta.alias("d"), same, "full")
        key = {k: F.coalesce(F.col(f"v.{k}"), F.col(f"d.{k}")) for k in keys}
        rows = F.coalesce(F.col(f"v.{self.count}"), F.lit(0)) + F.coalesce(F.col("d._d_rows"), F.lit(0))
        out = [key[k].alias(k) for k in keys] + [rows.cast("bigint").alias(self.count)]
        for m, (f, _) in self.measures.items():
            old, new = F.col(f"v.{m}"), F.col(f"d._d_{m}")
            if f in ("sum", "count"):
                value = F.when(old.isNull() & new.isNull(), None).otherwise(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)))
            else:
                value = (F.least if f == "min" else F.greatest)(old, new)
            out.append(value.alias(m))
        hurt = F.coalesce(F.col("d._d_least"), F.lit(0)) < 0
        merged = both.select(*out, hurt.alias("_hurt")).filter(F.col(self.count) > 0)
        if source_after is None:
            only = F.when(F.col("_hurt"), F.raise_error(F.lit("a delete needs the source")).cast("bigint")).otherwise(F.col(self.count))
            return merged.withColumn(self.count, only).drop("_hurt")
        if all(f == "count" for f, _ in self.measures.values()):
            return merged.drop("_hurt")
        # groups that lost rows: MIN and MAX, and whether a SUM is NULL, come from their remaining rows
        touched = delta.filter("_d_least < 0").select(*[F.col(k).alias(f"_t_{k}") for k in keys])
        cond = None
        for k in keys:
            one = F.col(f"_k_{k}").eqNullSafe(F.col(f"_t_{k}"))
            cond = one if cond is None else cond & one
        again = self._grouped(self._rows(source_after).join(touched, cond, "left_semi"))
        return merged.filter("not _hurt").drop("_hurt").unionByName(again.select(*[c for c in merged.columns if c != "_hurt"]))


def keep_newest(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Row-limit retention: the first ``rows`` rows by a total order."""
    return df.orderBy(*order).limit(rows)


def evict_before_insert(df: DataFrame, incoming: DataFrame, order: list[Column], limit: int, evict: int, partition: Column | None = None) -> DataFrame:
    """LIMIT PARTITION ROWS: a partition at its limit first loses its ``evict`` oldest rows, then takes the new ones.

    Applied to a batch: eviction repeats until the batch fits, as it would have row by row. ``partition`` numbers the
    partitions of both sides (one by default). A partition holds at most ``limit`` rows and its share of the batch, which
    bounds the window that ranks its rows.
    """
    site = F.lit(0) if partition is None else partition
    rows = df.withColumns({"_site": site, "_new": F.lit(0)}).unionByName(incoming.withColumns({"_site": site, "_new": F.lit(1)}))
    whole, oldest = Window.partitionBy("_site"), Window.partitionBy("_site").orderBy("_new", *order)
    over = F.count(F.lit(1)).over(whole) - F.lit(limit)
    gone = F.when(over > 0, F.least(F.sum(1 - F.col("_new")).over(whole), F.ceil(over / F.lit(evict)) * evict)).otherwise(0)
    return rows.withColumns({"_gone": gone, "_rank": F.row_number().over(oldest)}).filter("_rank > _gone").select(*df.columns)


def keep_after(df: DataFrame, ts: str, oldest: Column) -> DataFrame:
    """Age retention."""
    return df.filter(F.col(ts) > oldest)
