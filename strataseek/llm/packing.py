"""Best-fit-decreasing packing of token sequences, at any scale.

Documents longer than a window are first cut into full windows. What is left is packed
by best-fit decreasing: pieces from long to short, each into the open window with the
least room that still holds it, found by a segment tree over remaining capacity. Pieces
of one length are alike, so the plan is made from the *counts* of the 2048 lengths
alone: it says which ranks within a length go to which windows. Its size depends on
the window, never on the number of documents, and it equals piece-by-piece best fit.
Ranks come from counts by (task, length), so no length, however common, meets in one
task.

Null texts count as empty and hold the end id alone; repeated rows are packed row by
row; an empty table packs to nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, slices_by_bytes, stash
from .token_memo import memo_of

WINDOW = 2048


class CapacityTree:
    """How many open windows have each remaining capacity; ``at_least(n)`` finds the
    smallest capacity >= n that any has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def at_least(self, n: int) -> int | None:
        i = n + self.leaves
        if i >= 2 * self.leaves:
            return None
        if self.count[i]:
            return n
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first window, pieces a window, offset in the window):
    the pieces of a length from a rank on fill windows one after the other."""
    tree, runs, made = CapacityTree(window), [], 0
    open_: dict[int, list[tuple[int, int]]] = {}  # by capacity: first window, windows
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left > 0:
            room = tree.at_least(length)
            if room is None:
                room, each = window, window // length
                start, n = made, -(-left // each)
                made += n
            else:
                start, n = open_[room].pop()
                tree.add(room, -n)
                each = room // length
            full = min(n, left // each)
            runs.append((length, rank, start, each, window - room))
            over = min(each, left - full * each) if full < n else 0  # in one more window
            parts = [(room - each * length, start, full), (room - over * length, start + full, int(over > 0))]
            used = full + int(over > 0)
            parts.append((room, start + used, n - used))
            placed = full * each + over
            for capacity, s, k in parts:
                if not k:
                    continue
                if capacity > 0:
                    open_.setdefault(capacity, []).append((s, k))
                    tree.add(capacity, k)
            left -= placed
            rank += placed
    return runs


def cut(docs: DataFrame, spec: str, end_id: int = 1, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` tokens: shard, rank (within shard and length),
    doc_id, start, length, ids_crc32, doc_tokens and, if asked for, their ids."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["shard", "rank", "doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]

    def run(batches):
        memo, seen, shard = memo_of(spec), Counter(), TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                out = []
                for doc, made in zip(batch.column(0).to_pylist(), memo.ids_of([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                    raw = made + end
                    total = len(raw) // 4
                    for s in range(0, total, window):
                        piece = raw[4 * s : 4 * (s + window)]
                        n = len(piece) // 4
                        out.append((shard, seen[n], doc, s, n, zlib.crc32(piece), total, piece)[: len(names)])
                        seen[n] += 1
                kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()][: len(names)]
                if out:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "shard int, rank bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids
    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, schema)


def assign(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (shard, rank, length, ...)."""
    counts = pieces.groupBy("shard", "length").agg(F.count("*").alias("c"))
    counts = stash(counts, "packing-counts")
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("c")).collect()}  # one row a length
    runs = plan(total, window)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "length", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    # a rank is below 2^47, so (length, rank) fits one long
    table = np.array(sorted((length << 47 | rank, start, each, offset) for length, rank, start, each, offset in runs), np.int64).reshape(-1, 4)

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            at = np.searchsorted(table[:, 0], length << 47 | rank, side="right") - 1
            nth = rank - (table[at, 0] & ((1 << 47) - 1))
            each = table[at, 2]
            kept = [batch.column(x) for x in out_names[:-2]]
            yield pa.record_batch([*kept, pa.array(table[at, 1] + nth // each), pa.array(table[at, 3] + nth % each * length)], names=out_names)

    fields = [f for f in pieces.schema.fields if f.name not in ("shard", "rank")]
    out_names = [f.name for f in fields] + ["sequence_id", "offset"]
    schema = pieces.select(*[f.name for f in fields]).schema.add("sequence_id", T.LongType()).add("offset", T.LongType())
    return pieces.join(base, ["shard", "length"]).mapInArrow(place, schema)


def pack(docs: DataFrame, spec: str, end_id: int = 1, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    return assign(stash(cut(docs, spec, end_id, window, keep_ids), "packing"), window)
