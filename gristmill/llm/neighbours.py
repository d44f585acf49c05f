"""Nearest neighbours by a block matrix join on int8 tiles with error bounds.

Vectors are scaled to unit length and quantised to int8 once, each with its own scale and its exact residual
norm, and packed into blocks: ids, int8 values, scales and residuals of a few thousand vectors in one row. Blocks
of queries meet blocks of candidates, and only these packed blocks are replicated. The integer product of a tile
gives every cosine up to a bound from the residual norms; pairs whose upper bound reaches the k-th best lower bound
of their query in the tile survive it. The residuals are quantised to int8 once more, which narrows the bounds of the
survivors some hundredfold, so that of many near copies only those that differ by less go on. The bounds of all tiles merge in a heap of the k best lower bounds of each
query, and the pairs that still reach the least of the heap, by then a few a query, are joined with the original
vectors and computed in double precision. Nothing is missed, so recall is 1.

Equal vectors give equal scores and ties go to the smaller id, so among equal vectors only the k + 1
smallest ids can be among the k nearest (one may be the query's own); rows are made distinct first, the others stay out of the tiles,
which takes away large groups of copies without a loss.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null
ids; vectors of different lengths are compared with their own length only; rows that repeat an id act as one row (the
least of their vectors); an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize

QUERY_BLOCK, CANDIDATE_BLOCK, TILE_QUERIES = 2048, 8192, 256
_PARTS = ("ids", "quantised", "scales", "residuals", "finer", "finer_scales", "finer_residuals")
_BLOCK = "dim int, block int, " + ", ".join(f"{c} binary" for c in _PARTS)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of tiny or huge components would leave the range
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and residual norms of the vectors scaled to unit length."""
    return _levels(unit_vectors(vectors))[:3]


def _levels(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    scale = np.maximum(np.abs(unit).max(axis=1) / 127.0, np.finfo(float).tiny)
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - values * scale[:, None]
    return values, scale, np.linalg.norm(rest, axis=1), rest


def pack_block(rows: pa.Table) -> pa.Table:
    """One row for the vectors of a block, quantised, and their residuals quantised again."""
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    *level, rest = _levels(unit_vectors(flat.reshape(len(rows), -1)))
    parts = [rows.column("id").to_numpy().astype(np.int64), *level, *_levels(rest)[:3]]
    key = [rows.column(c).combine_chunks().slice(0, 1) for c in ("dim", "block")]
    return pa.table([*key, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["dim", "block", *_PARTS])


def unpack(row: dict, side: str) -> tuple[np.ndarray, ...]:
    raw = [row[f"{side}_{c}"] for c in _PARTS]
    ids = np.frombuffer(raw[0], np.int64)
    matrix = lambda x: np.frombuffer(x, np.int8).reshape(len(ids), -1)
    return ids, matrix(raw[1]), *map(np.frombuffer, raw[2:4]), matrix(raw[4]), *map(np.frombuffer, raw[5:7])


def _kth_of(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group, minus infinity in groups of fewer."""
    order = np.lexsort((-value, group))
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    out = np.full(groups, -np.inf)
    out[group[order[rank == k - 1]]] = value[order[rank == k - 1]]
    return out


def tile_bounds(queries: tuple, candidates: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, lower and upper bounds of the cosines) of the pairs of a tile that can be among the k nearest."""
    c_ids, cv, cs, ce, cv2, cs2, ce2 = candidates
    cf = cv.astype(np.float32)  # products of int8 sum exactly in float32 up to 1,040 components; beyond, the bound covers the rounding
    fine = cv * cs[:, None] + cv2 * cs2[:, None]
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(queries[0]), TILE_QUERIES):
        ids, qv, qs, qe, qv2, qs2, qe2 = (x[lo : lo + TILE_QUERIES] for x in queries)
        near = (qv.astype(np.float32) @ cf.T) * (qs[:, None] * cs[None, :]).astype(np.float32)
        slack = (qe[:, None] + (1.0 + qe[:, None]) * ce[None, :] + 1e-5 + 1e-7 * cf.shape[1]).astype(np.float32)
        own = ids[:, None] == c_ids[None, :]
        low = np.where(own, -np.inf, near - slack)
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(ids), -np.inf)
        i, j = np.nonzero((near + slack >= kth[:, None]) & ~own)
        finer = qv * qs[:, None] + qv2 * qs2[:, None]
        product = np.concatenate([np.einsum("ij,ij->i", finer[i[a : a + 65536]], fine[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
        slack = qe2[i] + (1.0 + qe2[i]) * ce2[j] + 1e-9
        low, high = product - slack, product + slack
        keep = high >= _kth_of(i, low, k, len(ids))[i]
        found.append((ids[i[keep]], c_ids[j[keep]], low[keep], high[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, components added in order."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda m, n: m * n), F.lit(0.0), lambda acc, z: acc + z)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total(a, b) / F.sqrt(total(a, a) * total(b, b))))


def blocks(rows: DataFrame, count: int) -> DataFrame:
    """Packed blocks of rows (id, dim, v), dealt by a hash of the id."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return dealt.select("dim", "block", "id", "v").groupBy("dim", "block").applyInArrow(pack_block, _BLOCK)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by cosine of each row whose id is divisible by ``every``."""
    v = F.col("v")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = clean.filter(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    )
    clean = materialize(clean.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    same = Window.partitionBy("v").orderBy("id")
    pool = clean.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k + 1).drop("_r")
    asked = clean.filter(F.col("id") % every == 0)
    n_asked, n_pool = asked.count(), clean.count()
    qb, cb = max(1, -(-n_asked // QUERY_BLOCK)), max(1, -(-n_pool // CANDIDATE_BLOCK))
    sided = lambda df, side, other, n: df.select("dim", F.col("block").alias(f"{side}_block"), *[F.col(c).alias(f"{side}_{c}") for c in _PARTS]).withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tiles = sided(blocks(asked, qb), "q", "c", cb).join(sided(blocks(pool, cb), "c", "q", qb), ["dim", "q_block", "c_block"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                got = tile_bounds(unpack(row, "q"), unpack(row, "c"), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "low", "high"])

    pairs = materialize(tiles.mapInArrow(bound, "query_id long, vec_id long, low double, high double"), "bounds")
    # a heap of k lower bounds for each query: pushed on, the least leaves
    best = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    heap = pairs.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).alias("least"))
    kept = pairs.join(heap, "query_id").filter(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query_id", "vec_id")
    of = lambda name, out: clean.select(F.col("id").alias(name), F.col("v").alias(out))
    exact = kept.join(of("query_id", "_q"), "query_id").join(of("vec_id", "_c"), "vec_id").select("query_id", "vec_id", cosine(F.col("_q"), F.col("_c")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
