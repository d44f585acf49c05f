"""Jump consistent hashing of documents into shards, by Spark expressions alone.

A stable key (doc_id) walks the jump sequence: from shard b the next jump goes to
``floor((b + 1) / u)`` with u the key's next uniform number, and the last shard below the shard count
holds the key. Appending a shard moves a key only into the new shard, and 1 key of n + 1 on average; no
ring table exists. The uniform numbers are xxhash64 of (key, step), so they are the same on every executor.

Slots are gapless within a shard, numbered through hashed buckets, so no task holds a whole shard.

Defined cases: a null text counts as empty (size 1, crc 0); a null key is a key of its own; repeated rows
each get a slot; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import gapless, materialize


def jump_hash(key: Column, shards: int, seed: int = 0) -> Column:
    """Shard (0 .. shards-1) of a key as an int column."""
    steps = F.array(*[F.struct(F.lit(i).alias("i")) for i in range(shards)])
    start = F.struct(F.lit(-1.0).alias("at"), F.lit(0.0).alias("next"))

    def step(state: Column, s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["i"], F.lit(seed)), 33).cast("double") + 1.0) / float(1 << 31)
        go = state["next"] < float(shards)
        return F.struct(
            F.when(go, state["next"]).otherwise(state["at"]).alias("at"),
            F.when(go, F.floor((state["next"] + 1.0) / u).cast("double")).otherwise(state["next"]).alias("next"),
        )

    return F.aggregate(steps, start, step, lambda state: state["at"].cast("int"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col(id_col), shards).alias("shard"),
        jump_hash(F.col(id_col), shards + 1).alias("grown_shard"),
    )
    sized = materialize(sized, "sized")
    slotted = gapless(sized, ["shard"], F.xxhash64("doc_id", "text_crc32", "size"), ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
