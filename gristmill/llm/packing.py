"""Best-fit packing of token sequences into rows of a fixed length.

Documents become ids of a byte-level BPE plus an end id; a text that spells an added token of the tokenizer file holds
that token's id, as by ``tokenizers``. Documents longer than a sequence are cut into
whole sequences from their end backwards, so only the first piece may be shorter.

Bulk-synchronous best-fit. Pieces longer than half a sequence open theirs at once, since no two of them share one.
Then rounds follow until no piece is left:

1. pieces and open gaps are range-sorted together by size into tasks of about ``sweep_rows`` rows; ties are split;
2. every task sweeps its range, longest piece first: a piece goes to its successor, the smallest gap that holds it, and the
   gap shrinks; only in the task of the largest sizes, beyond which there is no larger gap, do pieces open sequences;
3. pieces without a successor in their task and gaps left over have ranks in it. From the largest range down, the pieces of
   a range get the gaps of the nearest larger range, by rank, so that no two ask for one gap; the driver sees only
   counts, a row for each task. As many of the pieces still without a gap as the tokens call for open sequences;
4. the gaps are updated, those that no piece fits any more leave, and the next round begins.

With one task this is sequential best-fit-decreasing; with many, about as many sequences come out.

Defined cases: a null text is empty and yields the end id alone; repeated rows are packed each by itself;
an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import array
import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import arrow_batches, materialize

#: Pieces that byte-level BPE encodes apart: no token runs from a non-space into a space.
_SPLIT = re.compile(r"(?<=\S)(?=[ \n])")
_CACHE_SIZE = 300_000
#: Pieces and gaps that one task sweeps.
SWEEP_ROWS = 1 << 16


def _byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(extra)] = b
            extra += 1
    return table


def _added_pattern(token: dict) -> str:
    """Where a tokenizer file's added token stands in a text, with the spaces it takes in."""
    body = f"({re.escape(token['content'])})"
    if token.get("single_word"):
        body = rf"(?<!\w){body}(?!\w)"
    return (r"\s*" if token.get("lstrip") else "") + body + (r"\s*" if token.get("rstrip") else "")


class Encoder:
    """Ids of texts by the byte-level BPE in a tokenizer file, with a bounded memory of pieces already encoded."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        special = {t["content"] for t in added}
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.at_added = re.compile("|".join(map(_added_pattern, sorted(added, key=lambda t: -len(t["content"]))))) if added else None
        table = _byte_table()
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, the file's added tokens as their own ids wherever the text holds them."""
        if self.at_added is None or not self.at_added.search(text):
            return self.encode(text)
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self.encode(text[at : m.start()]), self.added[m[m.lastindex]]]
            at = m.end()
        return b"".join([*out, self.encode(text[at:])])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of text in which added tokens are ordinary text."""
        if not text:
            return b""
        parts = _SPLIT.split(text)
        known = self.known
        new = set(parts).difference(known)
        if len(known) + len(new) > _CACHE_SIZE:
            known.clear()
            new = set(parts)
        one = self.bpe.encode_ordinary
        for part in new:
            known[part] = array.array("I", one(part)).tobytes()
        return b"".join(map(known.__getitem__, parts))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def piece_starts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids: all of full length but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pattern)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(text.as_py() or "") + end
                n = len(ids) // 4
                starts = piece_starts(n, capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_SWEPT = [("kind", pa.int8()), ("part", pa.int32()), ("rank", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("seq", pa.int64()), ("offset", pa.int32())]
_SWEPT_SQL = "kind byte, part int, rank long, id long, size int, seq long, offset int"
PLACED, WAITING, OPEN, SHRUNK = 0, 1, 2, 3


def sweep(ids: np.ndarray, lengths: np.ndarray, seqs: np.ndarray, gaps: np.ndarray, capacity: int, opens: bool) -> tuple[list, list, list, list]:
    """One best-fit sweep over pieces, longest first: each goes to its successor, the smallest gap that holds it.

    Returns placed (id, seq, offset, length), waiting (id, length), gaps still open to any piece of a smaller range (seq,
    gap, smallest first) and gaps too small for the pieces here. A gap that a piece has shrunk can be chosen again. Where
    ``opens`` is set, a piece without a successor opens a sequence that bears its id.
    """
    order = np.lexsort((ids, -lengths))
    least = int(lengths.min()) if len(lengths) else 0
    stacks: dict[int, list[int]] = {}
    for s, g in sorted(zip(seqs.tolist(), gaps.tolist()), reverse=True):
        stacks.setdefault(g, []).append(s)
    sizes = sorted(stacks)
    placed, waiting, shrunk = [], [], []
    for i, n in zip(ids[order].tolist(), lengths[order].tolist()):
        at = bisect.bisect_left(sizes, n)
        if at < len(sizes):
            gap = sizes[at]
            seq = stacks[gap].pop()
            if not stacks[gap]:
                del stacks[gap], sizes[at]
        elif opens:
            gap, seq = capacity, i
        else:
            waiting.append((i, n))
            continue
        placed.append((i, seq, capacity - gap, n))
        rest = gap - n
        if rest >= least:
            if rest not in stacks:
                stacks[rest] = []
                bisect.insort(sizes, rest)
            stacks[rest].append(seq)
        elif rest:
            shrunk.append((seq, rest))
    return placed, waiting, [(s, g) for g in sizes for s in stacks[g]], shrunk


def sweep_partition(batches: Iterator[pa.RecordBatch], capacity: int, largest: int) -> Iterator[pa.RecordBatch]:
    """The sweep of one range of sizes. No other range has larger gaps than the one of the largest size, so there pieces open sequences."""
    rows = list(batches)
    if not sum(b.num_rows for b in rows):
        return
    part = TaskContext.get().partitionId()
    is_piece, ids, size = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in ("is_piece", "id", "size"))
    gap = ~is_piece
    placed, waiting, still, shrunk = sweep(ids[is_piece], size[is_piece], ids[gap], size[gap], capacity, int(size.max()) >= largest)
    out: list[tuple] = [(PLACED, part, 0, i, n, s, o) for i, s, o, n in placed]
    out += [(WAITING, part, r, i, n, 0, 0) for r, (i, n) in enumerate(waiting)]
    out += [(OPEN, part, r, s, g, s, 0) for r, (s, g) in enumerate(still)]
    out += [(SHRUNK, part, 0, s, g, s, 0) for s, g in shrunk]
    columns = list(zip(*out))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _SWEPT)], names=[n for n, _ in _SWEPT])


def settle(ranges: list[dict], capacity: int) -> np.ndarray:
    """Which waiting pieces go to which open gaps of larger ranges, and which open sequences, by rank.

    ``ranges`` holds a row for each range of sizes, in the order of size: numbers of waiting pieces and of open gaps, the
    longest piece, the least gap, and tokens of both. Ranges are passed from the largest down; pieces take the open
    gaps of the nearest larger range first, several pieces a gap where any of them fit together. Of the
    pieces without a gap as many open sequences, the longest first, as the tokens that the gaps cannot hold will fill.
    Rows: range, first rank, last rank + 1, range of the gaps (-1: a sequence of its own), first gap, pieces a gap.
    """
    stack: list[list[int]] = []  # range, next gap, number of gaps, least gap
    out, left, room = [], [], 0
    for row in reversed(ranges):
        rank, n = 0, row["waiting"]
        while rank < n and stack:
            q, at, have, least = stack[-1]
            per = max(1, least // row["longest"])
            used = min(have - at, -(-(n - rank) // per))
            end = min(n, rank + used * per)
            out.append((row["part"], rank, end, q, at, per))
            rank, stack[-1][1] = end, at + used
            if stack[-1][1] == have:
                stack.pop()
        if rank < n:
            left.append((row["part"], rank, n, row["tokens"] * (n - rank) // n))
        if row["gaps"]:
            stack.append([row["part"], 0, row["gaps"], row["least"]])
        room += row["gap_tokens"]
    opened = -(-max(sum(x[3] for x in left) - room, 0) // capacity)
    for part, first, last, _ in left:
        k = min(opened, last - first)
        if k:
            out.append((part, first, first + k, -1, 0, 1))
            opened -= k
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    arrow_batches(docs.sparkSession)
    cut = materialize(pieces(docs, tokenizer, pattern, capacity, end_id, id_col, text_col).withColumn("id", F.monotonically_increasing_id()), "pieces")
    # no two pieces longer than half a sequence share one, so all of these open theirs at once
    large = F.col("length") * 2 > capacity
    places = [cut.filter(large).select("id", F.col("id").alias("seq"), F.lit(0).alias("offset"))]
    state = cut.select((~large).alias("is_piece"), "id", F.when(large, capacity - F.col("length")).otherwise(F.col("length")).cast("int").alias("size")).filter("size > 0")
    while True:
        about = state.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"), F.min(F.when(F.col("is_piece"), F.col("size"))).alias("least")).first()
        if about["least"] is None:  # no piece is left
            break
        state = state.filter(F.col("is_piece") | (F.col("size") >= about["least"]))
        largest = about["largest"]
        # ties are split; what one task holds needs no ranges, and ends there
        ranged = state.coalesce(1) if about["n"] <= sweep_rows else state.repartitionByRange(-(-about["n"] // sweep_rows), F.col("size"), F.xxhash64("id"))
        swept = materialize(ranged.select("is_piece", "id", "size").mapInArrow(lambda batches, top=largest: sweep_partition(batches, capacity, top), _SWEPT_SQL), "swept")
        waiting, gap = F.col("kind") == WAITING, F.col("kind") == OPEN
        when = lambda cond, value: F.when(cond, F.col(value))
        ranges = swept.groupBy("part").agg(
            F.count(when(waiting, "id")).alias("waiting"), F.max(when(waiting, "size")).alias("longest"), F.coalesce(F.sum(when(waiting, "size")), F.lit(0)).alias("tokens"),
            F.count(when(gap, "id")).alias("gaps"), F.min(when(gap, "size")).alias("least"), F.coalesce(F.sum(F.when(F.col("kind").isin(OPEN, SHRUNK) & (F.col("size") >= about["least"]), F.col("size"))), F.lit(0)).alias("gap_tokens"),
        )
        plan = settle([r.asDict() for r in ranges.orderBy("part").collect()], capacity)  # one row for each task of the sweep
        places.append(swept.filter(F.col("kind") == PLACED).select("id", "seq", "offset"))
        if not len(plan):
            state = swept.filter(F.col("kind").isin(OPEN, SHRUNK, WAITING)).select((F.col("kind") == WAITING).alias("is_piece"), "id", "size")
            continue
        told = swept.filter(waiting).select("part", "rank", "id", "size").mapInArrow(lambda batches, plan=plan: assign(batches, plan), "id long, size int, to int, gap_rank long, slot long")
        told = materialize(told, "told")
        gaps = swept.filter(gap).select(F.col("part").alias("to"), F.col("rank").alias("gap_rank"), F.col("seq"), F.col("size").alias("gap"))
        here = Window.partitionBy("to", "gap_rank").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = materialize(told.filter("to >= 0").join(gaps, ["to", "gap_rank"]).withColumn("filled", F.sum("size").over(here)), "met")
        own = told.filter("to = -1")
        places += [met.select("id", "seq", (F.lit(capacity) - F.col("gap") + F.col("filled") - F.col("size")).cast("int").alias("offset")), own.select("id", F.col("id").alias("seq"), F.lit(0).alias("offset"))]
        used = met.groupBy("to", "gap_rank").agg(F.first("seq").alias("id"), (F.first("gap") - F.max("filled")).cast("int").alias("size"))
        a_gap = F.lit(False).alias("is_piece")
        state = (
            told.filter("to = -2").select(F.lit(True).alias("is_piece"), "id", "size")
            .unionByName(own.select(a_gap, "id", (F.lit(capacity) - F.col("size")).cast("int").alias("size")))
            .unionByName(used.filter("size > 0").select(a_gap, "id", "size"))
            .unionByName(gaps.join(used.select("to", "gap_rank"), ["to", "gap_rank"], "left_anti").select(a_gap, F.col("seq").alias("id"), F.col("gap").alias("size")))
            .unionByName(swept.filter(F.col("kind") == SHRUNK).select(a_gap, "id", "size"))
        )
        state = materialize(state, "state")
    placed = places[0]
    for more in places[1:]:
        placed = placed.unionByName(more)
    return cut.join(placed, "id").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def assign(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Range of the gap (-1: a sequence of its own, -2: waits on), rank of the gap and place in it, for each waiting piece."""
    stride = np.int64(1) << 40  # ranks within a task stay below it
    keys = plan[:, 0] * stride + plan[:, 1]
    for batch in batches:
        part, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "rank"))
        at = np.maximum(np.searchsorted(keys, part * stride + rank, side="right") - 1, 0)
        row = plan[at]
        inside = (row[:, 0] == part) & (row[:, 1] <= rank) & (rank < row[:, 2])
        step = rank - row[:, 1]
        columns = [batch.column("id"), batch.column("size"), pa.array(np.where(inside, row[:, 3], -2), pa.int32()), pa.array(row[:, 4] + step // row[:, 5]), pa.array(step % row[:, 5])]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "to", "gap_rank", "slot"])
