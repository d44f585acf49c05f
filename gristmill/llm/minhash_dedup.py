"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set holds the hashes of its distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased); a text of fewer words is one shingle; an empty or null text has an empty set and links with
nothing. Documents are linked where ``100 * |A & B| >= 85 * |A | B|`` (a parameter), and a group is a
connected component.

How it scales: sets equal to each other collapse first (one partial aggregate, however many copies there
are). Banding finds candidates: 16 bands of 4 SuperMinHash values miss a pair at 0.85 with probability below
1e-5; 32 bands (``slots`` = 128) one at 0.8 below 1e-7. Documents that share a bucket, directly or through
others, form candidate clusters by distributed label propagation; only their sets travel, once, and each cluster
is resolved exactly: two members are in one component if links over all pairs of the cluster join them. A small
cluster is resolved in one task by union-find. One whose sets exceed ``MAX_CLUSTER_SHINGLES`` is never gathered:
``link_large`` compares the pairs that share a shingle of their prefixes, which all pairs at the threshold do, in
distributed rounds. The size decides the way only; the components are the same.

Defined cases: null text is empty; a row without an id has a set but no component of its own (kept is null);
rows with one doc_id act as one document, linked by any of their texts, each row with the size of its own set; an
empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import kernels as K
from gristmill.llm.common import arrow_batches, discard, materialize

SHINGLE, SLOTS, BAND_ROWS = 5, 64, 4
#: Shingles of the clusters that one task resolves, about 200 MB of working arrays.
MAX_CLUSTER_SHINGLES = 4_000_000
#: Centres that a key names in the first round and, after doubling, at most.
CENTRES, MOST_CENTRES = 8, 128
_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the n+1 offsets."""
    words = K.words_of(raw, offsets, lower=True)
    counts = np.diff(words.first)
    full = np.maximum(counts - size + 1, 0)
    grams = K.ngram_hashes(words.hashes, size)
    first = words.first[:-1]
    doc = np.repeat(np.arange(len(counts)), full)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first, full)
    value = grams[at] if len(at) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = []
        for d in short:  # at most size-1 words each
            h = words.hashes[first[d] : first[d + 1] if d + 1 < len(first) else None][: counts[d]]
            own.append(K.ngram_hashes(h, len(h))[0])
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(own, dtype=np.uint64) + np.uint64(1)])
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))


def superminhash(values: np.ndarray, offsets: np.ndarray, slots: int = SLOTS, seed: int = 7) -> np.ndarray:
    """SuperMinHash signatures (texts x slots) of sets of hashes; slots is a power of two.

    Element e has a permutation of the slots and, at its j-th slot, the value j + u with u in [0, 1). A
    slot keeps its least value. Steps go level by level over all elements at once: values of level j are
    below all of later levels, so a text whose slots are all filled drops out early.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    best = np.full(n * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    a = K.mix(values + np.uint64(seed))
    stride = K.mix(a + np.uint64(0x51ED270B)) | np.uint64(1)  # odd: a permutation of a power of two
    low = np.uint64(slots - 1)
    open_rows = np.arange(len(values))
    for level in range(slots):
        if not len(open_rows):
            break
        e = a[open_rows]
        slot = ((e + stride[open_rows] * np.uint64(level)) & low).astype(np.int64)
        u = K.mix(e ^ np.uint64((level + 1) * 0x2545F4914F6CDD1D & (2**64 - 1))) >> np.uint64(7)
        key = (np.uint64(level) << np.uint64(57)) | u
        np.minimum.at(best, doc[open_rows] * slots + slot, key)
        filled = (best.reshape(n, slots) != np.iinfo(np.uint64).max).all(axis=1)
        open_rows = open_rows[~filled[doc[open_rows]]]
    return best.reshape(n, slots)


def band_keys(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One key for each band of ``rows`` slots; the band's number is part of it."""
    n, slots = signatures.shape
    grouped = K.mix(signatures).reshape(n, slots // rows, rows)
    weights = K.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    total = (grouped * weights).sum(axis=2, dtype=np.uint64)
    return K.mix(total + np.arange(slots // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketch(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = K.text_buffer(batch.column("text"))
        ids = batch.column("doc_id")
        for lo, hi in K.slices(offsets):
            part = offsets[lo : hi + 1]
            values, first = shingle_sets(raw[part[0] : part[-1]], part - part[0])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(values))])
            more = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
            bands = K.signed(band_keys(superminhash(values, first, slots)))
            per = bands.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo).cast(pa.int64()),
                    pa.array(np.diff(first)),
                    pa.array(K.signed(sums[first[1:]] - sums[first[:-1]])),
                    pa.array(K.signed(more[first[1:]] - more[first[:-1]])),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, per, dtype=np.int32)), pa.array(bands.reshape(-1))),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = K.text_buffer(batch.column("text"))
        for lo, hi in K.slices(offsets):
            part = offsets[lo : hi + 1]
            values, first = shingle_sets(raw[part[0] : part[-1]], part - part[0])
            data = pa.py_buffer(np.ascontiguousarray(values))
            column = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * 8).astype(np.int32)), data])
            yield pa.RecordBatch.from_arrays([batch.column("cluster").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), column], names=["cluster", "doc_id", "shingles"])


def link_components(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component (smallest id) of each document: exact union-find over all pairs that meet the threshold.

    Members are taken from the most typical on; each is compared in one vectorised pass with those not yet
    in its component and of a size that can meet the threshold. Sets of one id are in one component.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    vocabulary, code, spread = np.unique(flat, return_inverse=True, return_counts=True)
    # postings: owners by shingle, so a member meets only those that share shingles with it
    order = np.argsort(code, kind="stable")
    posted, begin = owner[order], np.concatenate([[0], np.cumsum(spread)])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    typical = np.add.reduceat(spread[code], firsts[:-1]) / sizes if n else np.zeros(0)
    labels = np.unique(ids, return_inverse=True)[1]
    components = len(np.unique(labels))
    for i in np.argsort(-typical, kind="stable"):
        if components == 1:
            break
        mine = code[firsts[i] : firsts[i + 1]]
        mine = mine[spread[mine] > 1]
        if not len(mine):
            continue
        counts = np.bincount(posted[_ranges(begin[mine], begin[mine + 1])], minlength=n)
        union = sizes + sizes[i] - counts
        near = np.flatnonzero((100 * counts >= percent * union) & (labels != labels[i]))
        if len(near):
            merged = np.unique(np.append(labels[near], labels[i]))
            labels[np.isin(labels, merged)] = merged[0]
            components -= len(merged) - 1
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, labels, ids)
    return least[labels]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All indices of the ranges [begin, end), one after another."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def clusters(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label of each node of a (node, key) graph: the smallest node reachable over shared keys.

    Labels pass from nodes to keys and back by partial aggregates, so a key with many nodes costs no more
    than its rows; pointers are shortened each round, which keeps the rounds few on long chains.
    """
    labels = materialize(pairs.groupBy("node").agg(F.min("node").alias("label")), "labels")
    for _ in range(most_rounds):
        by_key = pairs.join(labels, "node").groupBy("key").agg(F.min("label").alias("low"))
        got = pairs.join(by_key, "key").groupBy("node").agg(F.min("low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = materialize(
            got.join(jump, "low").select("node", F.least("low", "further").alias("label")), "labels"
        )
        moved = new.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            return labels
    raise RuntimeError("label propagation did not settle")


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(node, key): shingles of which two sets of one cluster share at least one wherever they meet the threshold.

    Shingles are ordered by how many sets of the cluster hold them, the rarest first. Sets A and B at the threshold
    share percent % of the larger one or more, so they meet within the first |A| - ceil(percent % of |A|) + 1 of A and
    the same of B. Shingles that one set alone holds are no keys.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, node, raw in zip(*(batch.column(c).to_pylist() for c in ("cluster", "doc_id", "shingles"))):
                values = np.frombuffer(raw, np.int64)
                n = len(values)
                part = int(K.signed(np.bitwise_xor.reduce(K.mix(values.view(np.uint64)), keepdims=True))[0])
                columns = [np.full(n, cluster), np.full(n, node), np.full(n, part), np.full(n, n - -(-percent * n // 100) + 1), values]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "node", "part", "few", "key"])

    rows = materialize(sets.mapInArrow(spell, "cluster long, node long, part long, few long, key long"), "shingles")
    spread = rows.groupBy("cluster", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rarest = Window.partitionBy("node", "part").orderBy(F.coalesce("n", F.lit(1)), "key")
    ranked = rows.join(spread, ["cluster", "key"], "left").withColumn("r", F.row_number().over(rarest))
    prefix = ranked.filter("r <= few and n > 1").select("cluster", "node", F.xxhash64("cluster", "key").alias("key")).distinct()
    shared = prefix.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return prefix.join(shared, "key").select("node", "key")


def _verified(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of asked whose sets meet the threshold; a row of two sets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                n = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append(100 * n >= percent * (len(x) // 8 + len(y) // 8 - n))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = asked.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    sizes = [F.length("x"), F.length("y")]
    both = both.filter(F.least(*sizes) * 100 >= F.greatest(*sizes) * percent)  # the smaller set bounds what is shared
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def link_large(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, component_id) of the members of large clusters, without gathering any.

    Members meet under the ``prefix_keys`` they share. In a round each key that still holds several components
    names centres outside its largest component, and every member of another component is verified against them;
    links merge components. A key is done when one component is left in it, or all members outside its largest
    component have been centres: every pair of different components in it has then been compared, and pairs within
    a component need no comparison. Keys that are done leave. A round costs rows in proportion to the members,
    however many a key has; the centres of a key double from CENTRES to MOST_CENTRES, so a key of m texts that are
    all unlike takes some m / MOST_CENTRES rounds.
    """
    pairs = materialize(prefix_keys(sets, percent), "keys")
    labels = materialize(sets.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")).distinct(), "labels")
    used, most = None, CENTRES
    while True:
        at = materialize(pairs.join(labels, "node"), "members")
        sizes = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", F.col("m.label").alias("top"))
        outside = at.join(largest, "key").filter("label <> top").drop("top")
        if used is not None:
            outside = outside.join(used, ["key", "node"], "left_anti")
        order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
        centres = materialize(outside.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("key", F.col("node").alias("b"), F.col("label").alias("other")), "centres")
        if centres.isEmpty():
            return labels.select(F.col("node").alias("rep"), F.col("label").alias("component_id"))
        asked = at.join(centres, "key").filter("label <> other").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        links = materialize(_verified(asked, sets, percent), "links")
        now = centres.select("key", F.col("b").alias("node"))
        open_keys = now.select("key").distinct()
        used = materialize(now if used is None else used.join(open_keys, "key").unionByName(now), "used")
        left = materialize(at.join(open_keys, "key").select("node", "key"), "keys")
        discard(pairs, at, centres)
        pairs, most = left, min(2 * most, MOST_CENTRES)
        if links.isEmpty():
            continue
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        edges = links.join(of("a"), "a").join(of("b"), "b").select("la", "lb").distinct()
        labels = materialize(_merge(labels, edges), "labels")


def _merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (with a column label) after the labels la and lb of each edge have become one, the least."""
    keyed = edges.withColumn("key", F.xxhash64("la", "lb"))
    graph = materialize(keyed.select(F.col("la").alias("node"), "key").unionByName(keyed.select(F.col("lb").alias("node"), "key")), "edges")
    merged = clusters(graph).select(F.col("node").alias("label"), F.col("label").alias("into"))
    return labels.join(merged, "label", "left").withColumn("label", F.coalesce("into", "label")).drop("into")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of docs."""
    spark = docs.sparkSession
    arrow_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialize(source.mapInArrow(lambda batches: _sketch(batches, slots), _SKETCH), "sketches")
    again = materialize(sketches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "again")
    repeats = not again.isEmpty()
    if repeats:  # one row for each text of an id, so that a cluster holds no set of an id twice
        source = source.join(again, "doc_id", "left_anti").unionByName(source.join(again, "doc_id", "left_semi").dropDuplicates())
    unique = ["n_shingles", "set_a", "set_b"]
    full = sketches.filter("n_shingles > 0")
    least = full.groupBy(*unique).agg(F.min("doc_id").alias("rep"))
    reps = materialize(full.join(least.withColumnRenamed("rep", "doc_id"), [*unique, "doc_id"]).dropDuplicates(unique), "reps")
    pairs = reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    shared = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    pairs = materialize(pairs.join(shared, "key"), "pairs")
    labels = clusters(pairs)
    members = labels.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"))
    weights = members.join(reps.select("doc_id", "n_shingles"), "doc_id").groupBy("cluster").agg(F.sum("n_shingles").alias("w"))
    large = materialize(weights.filter(F.col("w") > MAX_CLUSTER_SHINGLES).select("cluster"), "large")
    spell = lambda some: source.join(some, "doc_id").select("cluster", "doc_id", "text").mapInArrow(_sets, "cluster long, doc_id long, shingles binary")
    sets = spell(members.join(large, "cluster", "left_anti"))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = link_components(pdf["doc_id"].to_numpy(), [np.frombuffer(b, dtype=np.uint64) for b in pdf["shingles"]], percent)
        return pd.DataFrame({"rep": pdf["doc_id"].to_numpy(), "component_id": found}).drop_duplicates()

    linked = sets.groupBy("cluster").applyInPandas(resolve, "rep long, component_id long")
    if not large.isEmpty():
        linked = linked.unionByName(link_large(materialize(spell(members.join(large, "cluster")), "heavy_sets"), percent))
    least = least.join(linked, "rep", "left").select(*unique, F.coalesce("component_id", "rep").alias("component_id"))
    out = sketches.select("doc_id", *unique).join(least, unique, "left")
    if repeats:
        out = materialize(out.withColumn("label", F.coalesce("component_id", "doc_id")).drop("component_id"), "rows")
        of_id = out.join(again, "doc_id").groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("doc_id")
        several = out.join(of_id, "doc_id").select("doc_id", "label").distinct()
        first = several.groupBy("doc_id").agg(F.min("label").alias("la"))
        edges = materialize(several.join(first, "doc_id").select("la", F.col("label").alias("lb")).filter("la <> lb").distinct(), "ties")
        if not edges.isEmpty():
            out = _merge(out, edges)
        out = out.withColumnRenamed("label", "component_id")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept")
    )
