"""Benchmark decontamination by SimHash windows of item size, Hamming block indexes and exact verification.

Built from DataFrame functions alone. Words are split at white space and A-Z lower-cased; shingles are runs of
five words (an item of fewer words is one shingle of its own length).

1. Windows: for each size of an item, every window of that many words that can reach the similarity to any item of the
   size, wherever it starts. A window without enough shingles of the benchmark in it cannot, by count, whichever item
   it is held against; only these are left out, which loses nothing, and no item is chosen here. Benchmark shingles
   are broadcast only below ``broadcast_rows``, beyond that the join shuffles.
2. SimHash: each window gets the 64-bit SimHash of its shingles, each weighted by its count.
3. Multi-index: fingerprints are cut into 8 blocks of 8 bits. Two fingerprints within 23 bits agree in some block
   up to 2 bits, so items are listed under all block values within 2 bits and windows look up their own: every item of
   the window's size whose fingerprint is within the radius is found, and the items found are the only candidates.
4. Verification: multiset (count-weighted) Jaccard similarity of the shingles, exactly, at least 0.8.

Only documents with windows are read again for their shingles. Hot items or passages cost a row a document.

Defined cases: null or empty texts match nothing, nor do empty items; repeated items or documents report each id
once; ties between windows of a pair go to the more similar, then to the earlier one; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize

SHINGLE, BITS, BLOCKS, RADIUS, NEAR = 5, 64, 8, 23, 2
_BLOCK_BITS = BITS // BLOCKS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), 0)


def word_hashes(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lowered, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int) -> Column:
    """Hash of each run of ``size`` words."""
    def runs(ws: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)])
        return F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(0), F.size(ws) - size), at)).otherwise(F.array().cast("array<bigint>"))

    return let(words, runs)


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of an array of hashes; repeated hashes weigh by their count."""
    def of(hashes: Column) -> Column:
        def bit(b: Column) -> Column:
            votes = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
            return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))

    return let(shingles, of)


def block_values(fingerprint: Column) -> Column:
    """Array of (block number, value) of a fingerprint."""
    one = lambda i: F.struct(
        F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, i * _BLOCK_BITS).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int").alias("value")
    )
    return F.array(*[one(i) for i in range(BLOCKS)])


def masks() -> list[int]:
    """Every change of at most NEAR bits to a block."""
    return [sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in itertools.combinations(range(_BLOCK_BITS), k)]


def similarity(a: Column, b: Column) -> Column:
    """Count-weighted Jaccard similarity of two arrays of hashes."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return shared.cast("double") / (F.size(a) + F.size(b) - shared).cast("double")


def window_starts(seeds: Column, words: Column, n: Column, size: int, threshold: float) -> Column:
    """Starts of all windows of ``n`` words that hold as many of the sorted seed positions as the similarity takes.

    A window of x shingles and an item of y reach it only with threshold * (x + y) / (1 + threshold) in common.
    Each start belongs to the first seed at or after it, so none comes twice.
    """
    last, total = F.greatest(F.lit(0), words - n), n - (size - 1)
    held = F.least(total, words - (size - 1))
    need = F.greatest(F.lit(1), F.ceil((held + total) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)).cast("int"))

    def of(a: Column) -> Column:
        def at(i: Column) -> Column:
            low = F.greatest(F.lit(0), F.get(a, i + need - 1) - held + 1, F.coalesce(F.get(a, i - 1) + 1, F.lit(0)))
            high = F.least(F.get(a, i), last)
            return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

        return F.when(F.size(a) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(a) - need)), at))).otherwise(F.array().cast("array<int>"))

    return let(seeds, of)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity of the best window of each leaked item."""
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col).cast("string")).alias("w")).filter("size(w) > 0")
    items = items.withColumn("n", F.size("w")).withColumn("s", F.least(F.col("n"), F.lit(SHINGLE)))
    sizes = sorted(r["s"] for r in items.select("s").distinct().collect())  # at most 5 rows
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    found: DataFrame | None = None
    for size in sizes:
        own = items.filter(F.col("s") == size).withColumn("g", shingle_hashes(F.col("w"), size)).withColumn("print", simhash(F.col("g")))
        own = materialize(own.select("item_id", "n", "g", "print"), "items")
        vocabulary = own.select("n", F.explode("g").alias("h")).distinct()
        if vocabulary.count() <= broadcast_rows:
            vocabulary = F.broadcast(vocabulary)
        # texts stay below the generator, which would copy them for every shingle; the outer form infers no filter that spells them again
        spelt = source.select("doc_id", F.xxhash64("text").alias("th"), word_hashes(F.col("text")).alias("w")).select("doc_id", "th", F.size("w").alias("words"), shingle_hashes(F.col("w"), size).alias("g"))
        hits = spelt.select("doc_id", "th", "words", F.posexplode_outer("g").alias("at", "h")).join(vocabulary, "h")
        seeds = hits.groupBy("doc_id", "th", "words", "n").agg(F.sort_array(F.collect_set("at")).alias("seeds"))
        starts = seeds.select("doc_id", "th", "n", window_starts(F.col("seeds"), F.col("words"), F.col("n"), size, threshold).alias("starts")).filter("size(starts) > 0")
        starts = materialize(starts, "starts")
        asked = starts.groupBy("doc_id", "th").agg(F.flatten(F.collect_set(F.transform("starts", lambda st: F.struct("n", st.alias("start"))))).alias("asked"))
        texts = source.withColumn("th", F.xxhash64("text")).join(asked, ["doc_id", "th"])
        window = lambda a, g: F.struct(a["n"].alias("n"), a["start"].alias("start"), F.slice(g, a["start"] + 1, F.greatest(a["n"] - (size - 1), F.lit(1))).alias("wg"))
        cut = let(shingle_hashes(word_hashes(F.col("text")), size), lambda g: F.transform("asked", lambda a: window(a, g)))
        windows = texts.select("doc_id", "th", cut.alias("cut")).select("doc_id", "th", F.explode_outer("cut").alias("c")).select("doc_id", "th", "c.n", "c.start", "c.wg")
        windows = materialize(windows.withColumn("wprint", simhash(F.col("wg"))), "windows")
        values = F.explode(F.flatten(F.transform(block_values(F.col("print")), lambda b: F.transform(F.array(*[F.lit(m) for m in masks()]), lambda m: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(m).alias("value")))))).alias("k")
        index = own.select("item_id", "n", "print", values).select("item_id", "n", "print", "k.block", "k.value")
        if own.count() * BLOCKS * len(masks()) <= broadcast_rows:
            index, own = F.broadcast(index), F.broadcast(own)
        distance = F.bit_count(F.col("wprint").bitwiseXOR(F.col("print")))
        probes = windows.select("doc_id", "th", "n", "start", "wprint", F.explode(block_values(F.col("wprint"))).alias("k")).select("doc_id", "th", "n", "start", "wprint", "k.block", "k.value")
        near = probes.join(index, ["n", "block", "value"]).withColumn("hamming", distance).filter(F.col("hamming") <= RADIUS).select("doc_id", "th", "n", "start", "item_id", "hamming").distinct()
        checked = windows.join(near, ["doc_id", "th", "n", "start"]).join(own.drop("print"), ["item_id", "n"])
        checked = checked.withColumn("similarity", similarity(F.col("wg"), F.col("g"))).filter(F.col("similarity") >= threshold)
        best = checked.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"), F.col("n"), F.col("hamming"))).alias("b"))
        best = best.select("doc_id", "item_id", F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"), F.col("b.hamming").alias("hamming"), (-F.col("b.s")).alias("similarity"))
        found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id long, item_id {items.schema['item_id'].dataType.simpleString()}, start_word int, n_words int, hamming int, similarity double")
    return found
