"""Operators 3, 4 and 9 against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import lower, words
from pyspark.sql import functions as F

from gristmill.llm import common, fm_index, minhash_dedup, substring_dedup, suffix_dedup


def test_suffix_dedup(docs, texts):
    seen = Counter()
    bodies = [(d, (t or "").encode()) for d, t in texts]
    for _, b in bodies:
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    want = Counter()
    for d, b in bodies:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        left = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()] += 1
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).drop("kept").collect())
    assert got == want and sum(k[2] for k in want) > 0


@pytest.mark.parametrize("most", [1 << 22, 150])
def test_suffix_dedup_overlaps_and_edges(spark, most):
    rng = np.random.default_rng(1)
    a = "".join(map(chr, rng.integers(97, 123, 900)))
    rows = [(1, a), (2, a[100:299]), (3, a[500:700] + "é" * 300), (4, "ab" * 500), (None, a[:250]), (5, a[:199] + "#" + a[200:420])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = Counter()
    for _, t in rows:
        b = t.encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    for r in suffix_dedup.remove_repeats(df, long_text=most).collect():
        b = dict(rows)[r["doc_id"]].encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        assert r["n_removed"] == gone.sum() and r["kept"] == np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()


def seen_words(texts, span=13):
    by_id = defaultdict(set)
    for d, t in texts:
        w = words(t)
        by_id[d].update(tuple(w[p : p + span]) for p in range(len(w) - span + 1))
    least = {}
    for d, grams in by_id.items():
        for g in grams:
            least[g] = min(d, least.get(g, d))
    want = Counter()
    for d, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - span + 1):
            if least[tuple(w[p : p + span])] < d:
                gone[p : p + span] = [True] * span
        want[d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup.matched_windows, "__defaults__", (hot,))
    got = Counter(tuple(r) for r in substring_dedup.remove_seen(docs).drop("kept").collect())
    want = seen_words(texts)
    assert got == want and sum(k[2] for k in want) > 0


def test_substring_dedup_keeps_columns(docs):
    out = substring_dedup.remove_seen(docs, keep=["lang", "rid"])
    assert out.columns[-2:] == ["lang", "rid"] and out.count() == docs.count()


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(1, 6, rng.integers(1, 60)) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    owners = rng.permutation(40).astype(np.int64)
    index = fm_index.FMIndex(np.concatenate(seqs), offsets, owners, 5)
    streams = [rng.integers(0, 7, rng.integers(0, 50)) % 7 for _ in range(20)] + [seqs[3]]
    streams = [np.where(s > 5, 0, s) for s in streams]
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    length, owner = index.matching_statistics(np.concatenate(streams), cuts)
    have = defaultdict(lambda: np.iinfo(np.int64).max)
    for s, o in zip(seqs, owners):
        for k in range(1, 6):
            for p in range(len(s) - k + 1):
                key = tuple(s[p : p + k])
                have[key] = min(have[key], o)
    for s, a in zip(streams, cuts):
        for p in range(len(s)):
            best = max((k for k in range(1, 6) if p + k <= len(s) and tuple(s[p : p + k]) in have), default=0)
            assert length[a + p] == best
            if best == 5:
                assert owner[a + p] == have[tuple(s[p : p + 5])]


def components(texts, percent):
    sets = {}
    for d, t in texts:
        w = words(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and sets[a] and sets[b]:
                    k = len(sets[a] & sets[b])
                    if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                        low, high = sorted((label[a], label[b]))
                        label = {d: low if x == high else x for d, x in label.items()}
                        changed = True
    return {(d, len(sets[d]), label[d], label[d] == d) for d in sets}


def test_near_duplicates(docs, texts):
    got = [tuple(r) for r in minhash_dedup.near_duplicates(docs).collect()]
    assert set(got) == components(texts, 85) and len(got) == len(texts)


def test_near_duplicate_chains_and_hot_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):  # each step of the chain changes one more word
        w = list(base)
        w[: i // 2] = [f"c{i}_{k}" if k == i // 2 - 1 else f"d{k}" for k in range(i // 2)]
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choice(base, 30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows, 85)
    assert {tuple(r) for r in minhash_dedup.near_duplicates(df).collect()} == want
    monkeypatch.setattr(minhash_dedup, "MAX_CLUSTER_SHINGLES", 1000)  # the way of large clusters
    assert {tuple(r) for r in minhash_dedup.near_duplicates(df).collect()} == want


def test_large_clusters_get_the_answer_of_small_ones(spark, monkeypatch):
    """One band of four slots misses many pairs at the threshold; both ways compare all members of a cluster."""
    rng = np.random.default_rng(8)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(25):  # texts that share half of their words, in families of four near copies
        own = [f"o{i}_{k}" for k in range(60)]
        for j in range(4):
            w = common + own
            w[int(rng.integers(0, 120))] = f"x{i}_{j}"
            rows.append((10 * i + j, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = {tuple(r) for r in minhash_dedup.near_duplicates(df, slots=4).collect()}
    monkeypatch.setattr(minhash_dedup, "MAX_CLUSTER_SHINGLES", 200)
    monkeypatch.setattr(minhash_dedup, "CENTRES", 1)
    assert {tuple(r) for r in minhash_dedup.near_duplicates(df, slots=4).collect()} == small
    assert {tuple(r) for r in minhash_dedup.near_duplicates(df).collect()} == components(rows, 85)


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_an_id_with_several_texts_is_one_document(spark, monkeypatch, most):
    monkeypatch.setattr(minhash_dedup, "MAX_CLUSTER_SHINGLES", most)
    text = lambda c, changed=0: " ".join([f"{c}{k}" for k in range(100 - changed)] + [f"{c}x{k}" for k in range(changed)])
    rows = [(7, text("a")), (7, text("b")), (9, text("a", 2)), (3, text("b", 2)), (5, text("c")), (8, text("c")), (8, text("d")), (6, text("d")), (2, text("e"))]
    rows += [(7, text("a"))] * 5 + [(11, ""), (11, None), (11, text("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect())
    least = {7: 3, 9: 3, 3: 3, 5: 5, 8: 5, 6: 5, 2: 2, 11: 2}
    assert got == Counter((d, 96 if t else 0, least[d], d == least[d]) for d, t in rows)


def test_long_words_of_two_letters_do_not_collide(spark):
    """The 1,024-letter Thue-Morse word and its complement: equal under any polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rows = [(1, word), (2, other), (3, " ".join([word, *"pqrstuvwxyzpq"])), (4, " ".join([other, *"pqrstuvwxyzpq"])), (5, "c" + word), (6, word + "c"), (7, "c" + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in minhash_dedup.near_duplicates(df).collect()} == components(rows, 85)
    assert Counter(tuple(r) for r in substring_dedup.remove_seen(df).drop("kept").collect()) == seen_words(rows)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    hits = [np.mean(np.equal(*minhash_dedup.superminhash(np.concatenate([a, b]), np.array([0, 400, 800]), seed=s))) for s in range(40)]
    assert abs(np.mean(hits) - 0.6) < 0.03


def test_superminhash_varies_less_than_independent_slots():
    """Small sets, where correlated ranks help most: independent minima would have variance J (1 - J) / slots."""
    rng = np.random.default_rng(6)
    shared, total, slots = 20, 40, minhash_dedup.SLOTS
    estimates = []
    for s in range(400):
        u = rng.integers(0, 2**63, total).astype(np.uint64)
        a, b = u[: (total + shared) // 2], np.concatenate([u[:shared], u[(total + shared) // 2 :]])
        estimates.append(np.mean(np.equal(*minhash_dedup.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), seed=s))))
    j = shared / total
    assert abs(np.mean(estimates) - j) < 0.015 and np.var(estimates) < 0.85 * j * (1 - j) / slots


def test_suffix_dedup_pairs_anchors_once(docs, monkeypatch):
    """All anchors are shuffled and written in one round, and few tables are written: each write starts processes."""
    written, write = [], suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, label, **how: written.append((label, out := write(df, label, **how))) or out)
    suffix_dedup.remove_repeats(docs).count()
    labels = [label for label, _ in written]
    assert labels.count("paired") == 1 and len(labels) == 5
    assert not {"prefix_2", "prefix_4"} & set(dict(written)["anchors"].columns)


def test_suffix_dedup_splits_common_names(spark):
    """A join back to the rows deals a name that most rows share to several tasks."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("block"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    put = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        rows = suffix_dedup.materialize(rows.repartition(8), "rows")
        twice = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("block")
        held = suffix_dedup.holding(rows, twice, "block").withColumn("task", F.spark_partition_id())
        found = held.groupBy("task").agg(F.count("x").alias("n"), F.max("x")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in found) == 180_000 and max(r["n"] for r in found) < 90_000


def test_bare_tables_hold_their_checksums(spark):
    out = common.materialize(spark.range(5000).coalesce(1), "bare", bare=True)
    folder = Path(out.inputFiles()[0].removeprefix("file://")).parent
    assert sum(r["id"] for r in out.collect()) == 5000 * 4999 // 2
    assert not list(folder.glob(".*.crc"))
    (part,) = folder.glob("part-*")
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2] ^= 1
    part.write_bytes(raw)
    with pytest.raises(Exception, match="CRC checksum"):
        out.collect()


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert substring_dedup.remove_seen(no_docs).count() == 0
    assert minhash_dedup.near_duplicates(no_docs).count() == 0
