"""Removal of byte strings of 200 bytes that occur more than once, by minimizer winnowing and hash grouping.

This replaces distributed prefix doubling: no (rank, position) pairs are sorted and nothing is ranked again, since a
pair for each byte position is many times the input in every round (figures in the README). Equal strings are found by
equal fingerprints instead.

Every window of 200 bytes owns an anchor: the position, among its first 101, whose next 25 bytes hash least (the
leftmost on a tie). Equal windows own equal anchors at equal offsets, so a window can only repeat if the 100 bytes
from its anchor do: anchors whose fingerprint of these stands alone drop out, in one round. (A round on 50 bytes before
it would leave the same anchors.) Then:

1. all windows of an anchor as one block (200 bytes plus the windows' spread): blocks that occur twice settle
   all their windows at once, which is the bulk of any copied text;
2. blocks that do not, in four parts, each dropped if the bytes that its windows have in common are unique;
3. what is left, window by window, at exactly 200 bytes.

Fingerprints are 62 bits (two lanes modulo a prime), which name equal strings alike on every executor. One that a third
of all rows share costs one row a task in the partial aggregate; joins back to the rows are sort-merge joins that
adaptive execution splits (``holding``). A document's own spans are gathered by document only.

Defined cases: a null text is empty; texts under 200 bytes keep all; repeated rows repeat each other and are
removed whole where long enough; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import kernels as K
from gristmill.llm.common import arrow_batches, discard, materialize

SEED_BYTES, PARTS, LONG_TEXT = 25, 4, 1 << 22
_POS_BITS = np.uint64(31)


def anchors(raw: np.ndarray, offsets: np.ndarray, threshold: int) -> dict[str, np.ndarray]:
    """Anchors of all windows of ``threshold`` bytes: text number, place, first and last window start, fingerprints."""
    half = threshold // 2
    n = len(raw)
    names = ("text", "at", "first", "last", "prefix", "block")
    if n < threshold:
        return {k: np.zeros(0, dtype=np.int64) for k in names}
    sums = K.prefix_hashes(raw)
    at = np.arange(n - SEED_BYTES + 1)
    seeds = K.rolling_hashes(sums, SEED_BYTES)
    keys = (seeds >> _POS_BITS << _POS_BITS) | at.astype(np.uint64)
    least = K.sliding_min(keys, threshold - half + 1)
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - threshold + 1, 0)
    text = np.repeat(np.arange(len(lengths)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets[:-1], windows)
    anchor = (least[start] & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    text, place, first, last = text[head], anchor[head], start[head], start[tail]
    pair = lambda a, b: K.mix(a * np.uint64(0x9FB21C651E98DF25) + K.mix(b))
    two = lambda p: pair(seeds[p], seeds[p + SEED_BYTES])
    prefix = pair(two(place), two(place + 2 * SEED_BYTES))
    block = pair(K.span_hashes(sums, first, last + threshold), (place - first).astype(np.uint64))
    base = offsets[text]
    return dict(zip(names, (text, place - base, first - base, last - base, K.signed(prefix), K.signed(block))))


def anchors_in_parts(raw: np.ndarray, offsets: np.ndarray, threshold: int, most: int) -> dict[str, np.ndarray]:
    """``anchors`` with bounded memory: the windows of a text longer than ``most`` are taken part by part.

    A run of windows that a border splits gives two blocks in place of one, which later rounds resolve alike.
    """
    if len(offsets) != 2 or len(raw) <= max(most, threshold):
        return anchors(raw, offsets, threshold)
    found = []
    for at in range(0, len(raw) - threshold + 1, most):
        part = raw[at : at + most + threshold - 1]
        got = anchors(part, np.array([0, len(part)]), threshold)
        found.append(got | {k: got[k] + at for k in ("at", "first", "last")})
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _per_text(schema: list[tuple[str, pa.DataType]], run: Callable, most: int = 1 << 19) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow body: run(raw, offsets, batch rows lo:hi) -> columns, slice by slice."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.text_buffer(batch.column("text"))
            for lo, hi in K.slices(offsets, most):
                part = offsets[lo : hi + 1]
                columns = run(raw[part[0] : part[-1]], part - part[0], batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])

    return body


def repeated(names: DataFrame, column: str) -> DataFrame:
    """The values of a column that occur in more than one row."""
    return names.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(column)


def holding(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The rows whose value of a column is among the distinct ``names``.

    Names that an aggregate has just dealt by the column would be joined where they are, and a value that many rows
    share would stay with one task. A second key makes both sides shuffle, which adaptive execution can split.
    """
    keyed = lambda df: df.withColumn("_second", F.pmod(F.xxhash64(column), F.lit(1 << 20)))
    return keyed(rows).join(keyed(names), [column, "_second"]).drop("_second")


_SPANS = "array<struct<at:long,first:long,last:long>>"


def _spans(batch: pa.RecordBatch, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and slice positions (anchor, first, last) of the spans listed with each text."""
    listed = batch.column("spans")
    flat = listed.flatten()
    text = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
    base = offsets[:-1][text]
    at, first, last = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    return text, at + base, first + base, last + base


def duplicate_starts(source: DataFrame, threshold: int, long_text: int = LONG_TEXT) -> DataFrame:
    """(rid, first, last): ranges of starts of all ``threshold``-byte strings that also start elsewhere."""
    half = threshold // 2
    reach = threshold - half  # furthest distance from a window's start to its anchor
    width = -(-(reach + 1) // PARTS)

    def find(raw: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> list:
        got = anchors_in_parts(raw, offsets, threshold, long_text)
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        return [rid[got["text"]], got["at"], got["at"] - got["first"], got["at"] - got["last"], got["prefix"], got["block"]]

    schema = [("rid", pa.int64()), ("at", pa.int64()), ("back", pa.int16()), ("near", pa.int16()), ("prefix", pa.int64()), ("block", pa.int64())]
    rows = materialize(source.mapInArrow(_per_text(schema, find, min(long_text, 1 << 19)), "rid long, at long, back short, near short, prefix long, block long"), "anchors", bare=True)
    paired = materialize(holding(rows, repeated(rows, "prefix"), "prefix"), "paired", bare=True)  # anchors whose 100 bytes are unique leave
    discard(rows)
    rows = paired.select("rid", "at", (F.col("at") - F.col("back")).alias("first"), (F.col("at") - F.col("near")).alias("last"), "prefix", "block")
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("rid", "at", "first", "last", "prefix")).alias("_one"))
    twice = blocks.filter("_n > 1")
    settled = holding(rows, twice.select("block"), "block").select("rid", "first", "last")
    single = blocks.filter("_n = 1").select("_one.*", F.lit(True).alias("open"))
    # one copy of each repeated block stands in for all, where an open block shares its anchor's prefix
    models = twice.select("_one.*", F.lit(False).alias("open")).join(single.select("prefix").distinct(), "prefix").select(*single.columns)
    asked = single.unionByName(models)

    def with_text(spans: DataFrame) -> DataFrame:
        listed = spans.groupBy("rid").agg(F.collect_list(F.struct(*[c for c in spans.columns if c in ("at", "first", "last", "open")])).alias("spans"))
        return source.join(listed, "rid")

    def name_parts(raw: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> list:
        text, at, first, last = _spans(batch, offsets)
        sums = K.prefix_hashes(raw)
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        is_open = batch.column("spans").flatten().field(3).to_numpy(zero_copy_only=False)
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for part in range(PARTS):  # windows whose distance to the anchor is in [near, far]
            near, far = part * width, min((part + 1) * width - 1, reach)
            a, b = np.maximum(first, at - far), np.minimum(last, at - near)
            k = np.flatnonzero(a <= b)
            salt = K.mix(np.full(len(k), part, dtype=np.uint64))
            core = K.span_hashes(sums, at[k] - near, at[k] - far + threshold) + salt
            whole = K.mix(K.span_hashes(sums, a[k], b[k] + threshold) + K.mix((at[k] - a[k]).astype(np.uint64)))
            base = offsets[text[k]]
            for column, value in zip(columns, (rid[text[k]], at[k] - base, a[k] - base, b[k] - base, K.signed(core), K.signed(whole), is_open[k])):
                column.append(value)
        return [np.concatenate(c) for c in columns]

    part_schema = [*((c, pa.int64()) for c in ("rid", "at", "first", "last", "core", "whole")), ("open", pa.bool_())]
    parts = with_text(asked.select("rid", "at", "first", "last", "open")).select("rid", "text", "spans")
    parts = parts.mapInArrow(_per_text(part_schema, name_parts), ", ".join(f"{c} long" for c, _ in part_schema[:-1]) + ", open boolean")
    parts = materialize(parts, "parts", bare=True)
    wholes = parts.groupBy("whole").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("rid", "at", "first", "last", "core")).alias("_one"), F.max("open").alias("open"))
    settled_parts = holding(parts.filter("open"), wholes.filter("_n > 1").select("whole"), "whole").select("rid", "first", "last")
    cores = repeated(wholes.select("_one.core"), "core")  # of different parts, since copies have just been folded
    pending = wholes.select("_one.*", (F.col("_n") == 1).alias("lone"), "open").join(cores, "core")
    wanted = pending.filter("lone and open").select("core").distinct()
    pending = pending.join(wanted, "core").select("rid", "at", "first", "last")

    def name_windows(raw: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> list:
        text, _, first, last = _spans(batch, offsets)
        sums = K.prefix_hashes(raw)
        size = last - first + 1
        start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(text, size)
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        return [rid[owner], start - offsets[owner], K.signed(K.span_hashes(sums, start, start + threshold))]

    window_schema = [(c, pa.int64()) for c in ("rid", "first", "name")]
    windows = with_text(pending).select("rid", "text", "spans").mapInArrow(_per_text(window_schema, name_windows), "rid long, first long, name long")
    windows = materialize(windows, "windows", bare=True)
    settled_windows = holding(windows, repeated(windows, "name"), "name").select("rid", "first", F.col("first").alias("last"))
    return settled.unionByName(settled_parts).unionByName(settled_windows)


def covered(length: int, first: np.ndarray, last: np.ndarray, threshold: int) -> np.ndarray:
    """Mask of the bytes covered by a window that starts in one of the ranges."""
    delta = np.zeros(length + 1, dtype=np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, last + threshold, -1)
    return np.cumsum(delta[:-1]) > 0


def remove_repeats(docs: DataFrame, threshold: int = 200, id_col: str = "doc_id", text_col: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) of every document."""
    if threshold < 4 * SEED_BYTES or threshold % (8 * SEED_BYTES):
        raise ValueError("the threshold is a multiple of 200 bytes")
    arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    # rows alike in id and text share a rid: each is counted, so they repeat each other, and one list serves all
    ranges = materialize(duplicate_starts(source, threshold, long_text), "starts", bare=True)
    listed = ranges.groupBy("rid").agg(F.collect_list(F.struct(F.col("first").alias("at"), "first", "last")).alias("spans"))
    joined = source.join(listed, "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))

    def cut(raw: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> list:
        text, _, first, last = _spans(batch, offsets)
        bounds = np.searchsorted(text, np.arange(len(offsets)))
        out: list[tuple] = []
        for i in range(len(offsets) - 1):
            body, k = raw[offsets[i] : offsets[i + 1]], slice(bounds[i], bounds[i + 1])
            gone = covered(len(body), first[k] - offsets[i], last[k] - offsets[i], threshold) if bounds[i] < bounds[i + 1] else np.zeros(len(body), dtype=bool)
            left = body[~gone].tobytes()
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((len(body), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
        return [batch.column("doc_id"), *zip(*out)] if out else [[]] * 6

    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    return joined.select("doc_id", "text", "spans").mapInArrow(_per_text(schema, cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
