"""Removal of passages of 13 words that a document with a smaller id also holds, by FM-indexes per shard.

1. Every window of 13 words owns an anchor, the run of 4 words in it that hashes least; consecutive windows
   with one anchor make a block. Equal windows own equal anchors. Blocks whose anchor only one document holds
   cannot match and leave (one partial aggregate over anchors).
2. Blocks that are equal fold to one, owned by the least id among their documents: in all others the block goes
   whole. What is left to find is which windows of an owner's block occur in *other* blocks.
3. The distinct blocks are dealt to shards by anchor, so all that could match meet in one shard of bounded
   size. Each shard builds an FM-index of its blocks and streams them through it: matching statistics give,
   at each word, the longest match and the least owner of the matches of 13 words. An anchor with more
   distinct blocks than ``hot_blocks`` is dealt by single windows (folded alike), so it spreads over all shards.
4. Windows matched by a smaller id are covered, document by document, and the words left are joined.

Defined cases: a null text has no words; a null id is no document to others and loses nothing; rows with one
id count as one document; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import kernels as K
from gristmill.llm.common import arrow_batches, discard, materialize
from gristmill.llm.fm_index import FMIndex
from gristmill.llm.suffix_dedup import _per_text

ANCHOR_WORDS, SHARD_WORDS, HOT_BLOCKS = 4, 400_000, 2_000


def blocks_of(words: K.Words, span: int) -> dict[str, np.ndarray]:
    """Blocks of the windows of ``span`` words: text number, first and last window, anchor and content hashes."""
    counts = np.diff(words.first)
    windows = np.maximum(counts - span + 1, 0)
    grams = K.ngram_hashes(words.hashes, ANCHOR_WORDS)
    text = np.repeat(np.arange(len(counts)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(words.first[:-1], windows)
    if not len(start):
        return {k: np.zeros(0, dtype=np.int64) for k in ("text", "first", "last", "anchor", "block")}
    bits = np.uint64(28)
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    at = (K.sliding_min(keys, span - ANCHOR_WORDS + 1)[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    first, last, text = start[head], start[tail], text[head]
    sums = K.prefix_sums(words.hashes)
    block = K.span_hashes(sums, first, last + span)
    base = words.first[:-1][text]
    return {"text": text, "first": first - base, "last": last - base, "anchor": K.signed(grams[at[head]]), "block": K.signed(block)}


def search_shard(shard: pa.Table, span: int) -> pa.Table:
    """(block, piece, at) of the windows in a shard's sequences that a sequence of a smaller owner also holds."""
    raw, offsets = K.text_buffer(shard.column("words").combine_chunks())
    words = K.words_of(raw, offsets)
    owners = shard.column("owner").to_numpy()
    _, value = np.unique(words.hashes, return_inverse=True)
    value = value.astype(np.int64) + 1
    index = FMIndex(value, words.first, owners, span)
    length, least = index.matching_statistics(value, words.first)
    sequence = np.repeat(np.arange(len(owners)), np.diff(words.first))
    hit = np.flatnonzero((length == span) & (least < owners[sequence]))
    block, piece = shard.column("block").to_numpy()[sequence[hit]], shard.column("piece").to_numpy()[sequence[hit]]
    return pa.table({"block": block, "at": piece + hit - words.first[:-1][sequence[hit]], "owner": owners[sequence[hit]]})


def matched_windows(source: DataFrame, span: int, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(rid, first, last): ranges of windows whose words also start in a document with a smaller doc_id."""
    spark = source.sparkSession

    def find(raw: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> list:
        got = blocks_of(K.words_of(raw, offsets), span)
        rid, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "doc_id"))
        return [rid[got["text"]], doc[got["text"]], *(got[k] for k in ("first", "last", "anchor", "block"))]

    schema = [("rid", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("anchor", pa.int64()), ("block", pa.int64())]
    rows = source.filter("doc_id is not null").mapInArrow(_per_text(schema, find), "rid long, doc_id long, first int, last int, anchor long, block long")
    rows = materialize(rows, "blocks")
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    shared = materialize(shared, "shared")
    kept = materialize(rows.join(shared, "anchor"), "candidates")
    discard(rows, shared)
    rows = kept
    owned = rows.groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "rid", "first", "last")).alias("_o"))
    owned = materialize(owned.select("anchor", "block", F.col("_o.doc_id").alias("owner"), "_o.rid", "_o.first", "_o.last"), "owned")
    copies = rows.join(owned.select("block", "owner"), "block").filter("doc_id > owner").select("rid", "first", "last")

    hot = owned.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    told = owned.join(hot, "anchor").select("rid", F.struct("block", "anchor", "owner", "first", "last", (F.col("_n") > hot_blocks).alias("hot")).alias("b"))
    listed = told.groupBy("rid").agg(F.collect_list("b").alias("spans"))

    def spell(raw: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> list:
        words = K.words_of(raw, offsets)
        column = batch.column("spans")
        flat = column.flatten()
        block, anchor, owner, first, last, is_hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
        base = words.first[:-1][np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))]
        size = np.where(is_hot, last - first + 1, 1)  # a hot block goes window by window
        which = np.repeat(np.arange(len(block)), size)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        a = base[which] + first[which] + piece
        b = np.where(is_hot[which], a + span, (base + last + span)[which])
        route = np.where(is_hot[which], K.signed(K.span_hashes(K.prefix_sums(words.hashes), a, b)), anchor[which])
        start, end = words.start[a], words.end[b - 1]
        long = end - start
        body = raw[np.repeat(start - (np.cumsum(long) - long), long) + np.arange(long.sum())]
        spelt = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.append(0, np.cumsum(long)).astype(np.int32)), pa.py_buffer(body)])
        return [block[which], piece, owner[which], route, is_hot[which], spelt]

    spelt_schema = [("block", pa.int64()), ("piece", pa.int32()), ("owner", pa.int64()), ("route", pa.int64()), ("hot", pa.bool_()), ("words", pa.binary())]
    sequences = source.join(listed, "rid").select("rid", "text", "spans").mapInArrow(_per_text(spelt_schema, spell), "block long, piece int, owner long, route long, hot boolean, words binary")
    sequences = materialize(sequences, "sequences")
    total = sequences.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-int(total) // (6 * SHARD_WORDS)))
    # windows of hot blocks that are equal fold: an index needs the one of the least owner, the others lose to it
    windows = sequences.filter("hot")
    # written first, so that the join back is between two shuffles, which adaptive execution can split
    folded = materialize(windows.groupBy("route").agg(F.min(F.struct("owner", "block", "piece", "words")).alias("_o")), "folded")
    lost = windows.join(folded.select("route", F.col("_o.owner").alias("least")), "route").filter("owner > least").select("block", F.col("piece").cast("long").alias("at"), "owner")
    index = sequences.filter("not hot").select("block", "piece", "owner", "route", "words").unionByName(folded.select("_o.block", "_o.piece", "_o.owner", "route", "_o.words"))
    index = index.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    found = index.groupBy("shard").applyInArrow(lambda shard: search_shard(shard, span), "block long, at long, owner long").unionByName(lost)
    found = materialize(found, "matches")
    discard(sequences)
    own = rows.join(found, "block").filter("doc_id = owner").select("rid", (F.col("first") + F.col("at")).alias("first"), (F.col("first") + F.col("at")).alias("last"))
    return copies.select("rid", F.col("first").cast("long"), F.col("last").cast("long")).unionByName(own)


def remove_seen(docs: DataFrame, span: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined; the text as it is where none goes) of every document; and columns to keep."""
    spark = docs.sparkSession
    arrow_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    carried = keep or []
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(carried)])
    source = source.withColumn("rid", F.xxhash64("doc_id", "text"))
    ranges = materialize(matched_windows(source.select("doc_id", "text", "rid"), span), "seen").distinct()
    listed = ranges.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = source.join(listed, "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first:long,last:long>>")))
    order = ["doc_id", "text", "spans", *[f"_k{i}" for i in range(len(carried))]]
    joined = joined.select(*order)
    fields = [f for f in joined.schema.fields if f.name.startswith("_k")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.text_buffer(batch.column("text"))
            for lo, hi in K.slices(offsets):
                part = offsets[lo : hi + 1]
                here = batch.slice(lo, hi - lo)
                body = raw[part[0] : part[-1]]
                words = K.words_of(body, part - part[0])
                spans = here.column("spans")
                flat = spans.flatten()
                base = words.first[:-1][np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))]
                delta = np.zeros(len(words.start) + 1, dtype=np.int64)
                np.add.at(delta, flat.field(0).to_numpy(zero_copy_only=False) + base, 1)
                np.add.at(delta, flat.field(1).to_numpy(zero_copy_only=False) + base + span, -1)
                gone = np.cumsum(delta[:-1]) > 0
                counts, data, starts = np.diff(words.first), body.tobytes(), (part - part[0]).tolist()
                left: list[bytes] = []
                for i in range(len(counts)):
                    k = np.flatnonzero(~gone[words.first[i] : words.first[i + 1]]) + words.first[i]
                    left.append(b" ".join([data[a:b] for a, b in zip(words.start[k].tolist(), words.end[k].tolist())]))
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (counts > 0) if len(counts) else counts
                columns = [here.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), pa.array([x.decode() if r else data[a:b].decode() for x, r, a, b in zip(left, removed.tolist(), starts[:-1], starts[1:])], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *(here.column(f.name) for f in fields)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *(f.name for f in fields)])

    typed = "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)
    out = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" + typed)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(carried)])
