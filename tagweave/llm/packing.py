"""Best-fit-decreasing packing of token pieces into fixed-length sequences (operator 10).

Which pieces share a sequence depends on their lengths alone, and lengths lie between 1 and the
sequence length. So best-fit decreasing runs over the counts by length: a segment tree over
remaining capacities finds the tightest open capacity that fits in logarithmic time, and all open
bins of one kind take their pieces in one step. The result equals the algorithm run piece by piece,
needs memory for a few thousand kinds of bins however many documents there are, and every piece
finds its bin from its rank among the pieces of its length.

Defined results: null text counts as empty (the end id alone); repeated rows are packed as often as
they occur; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm import common
from tagweave.llm.tokens import encoder


class CapacityTree:
    """A segment tree over capacities 0..n that counts open bins and finds the tightest fit."""

    def __init__(self, n: int):
        self.width = 1 << n.bit_length()
        self.sums = [0] * (2 * self.width)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.width
        while at:
            self.sums[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open bin."""
        at = least + self.width
        if self.sums[at]:
            return least
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.width:
                    at *= 2
                    if not self.sums[at]:
                        at += 1
                return at - self.width
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(placements, number of bins) for ``counts`` pieces of each length.

    A placement (length, first_rank, pieces, first_bin, each, offset) says that pieces of that
    length with ranks from ``first_rank`` on fill bins from ``first_bin`` on, ``each`` to a bin, from
    ``offset``. Bins of one kind have consecutive numbers; a kind splits where a length runs out.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> (first bin, bins)
    placements, bins = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins[remaining].append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens; a sequence has {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                placements.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            rest = min(left, each) if full < n else 0
            if rest:
                placements.append((length, rank, rest, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
                left, rank = left - rest, rank + rest
            used = full + bool(rest)
            put(room, first + used, n - used)
    return placements, bins


def cut(tokens: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than ``size``."""
    first = tokens % size if tokens > size and tokens % size else min(tokens, size)
    return [(0, first), *((at, size) for at in range(first, tokens, size))]


class _Pieces:
    """Pieces with their rank among those of their length in the same task."""

    FIELDS = [("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def __init__(self, path: str, end_id: int, size: int, with_ids: bool, special: bool = False):
        self.special = special
        self.path, self.end_id, self.size, self.with_ids = path, end_id, size, with_ids
        self.schema = pa.schema(self.FIELDS + [("ids", pa.list_(pa.int64()))] * with_ids)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(self.path, special=self.special), TaskContext.get().partitionId()
        seen, end = [0] * (self.size + 1), np.asarray([self.end_id], "<u4").tobytes()
        for batch in common.slices(batches):
            out = defaultdict(list)
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                ids = memoryview(enc.raw(text) + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, self.size)):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (part, seen[length], doc, k, start, length, zlib.crc32(piece))
                    seen[length] += 1
                    for (name, _), v in zip(self.FIELDS, row, strict=True):
                        out[name].append(v)
                    if self.with_ids:
                        out["ids"].append(np.frombuffer(piece, "<u4").tolist())
            yield common.table(out, self.schema) if out else pa.RecordBatch.from_pylist([], self.schema)


def pack_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 1024, with_ids: bool = False, special: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    Texts are read and encoded once and never shuffled. What comes to the driver is one count for each
    length; what is broadcast is the list of placements, at most a few for each length.
    """
    spark = docs.sparkSession
    ddl = "part int, nth bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(_Pieces(tokenizer_path, end_id, size, with_ids, special), ddl)
    with common.few_texts(spark):
        pieces = common.materialise(pieces, "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    before = common.materialise(before, "ranks")  # one row per task and length
    totals = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placements, _ = best_fit_decreasing(totals, size)
    by_length: dict[int, list] = defaultdict(list)
    for p in placements:
        by_length[p[0]].append(p[1:])
    plan = spark.sparkContext.broadcast({k: np.asarray(v, np.int64) for k, v in by_length.items()})
    ranked = pieces.join(before.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("base")).drop("part", "nth", "base")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = ranked.select(*keep, "rank", *(["ids"] if with_ids else []))
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids + ", sequence_id bigint, offset bigint"
    return out.mapInArrow(_Place(plan), ddl)


class _Place:
    def __init__(self, plan):
        self.plan = plan

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = self.plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                k = int(length[group[0]])
                rows = plan[k]
                r = rank[group]
                first, _, base, each, offset = rows[np.searchsorted(rows[:, 0], r, "right") - 1].T
                seq[group], off[group] = base + (r - first) // each, offset + (r - first) % each * k
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq), pa.array(off)], names=[*kept.schema.names, "sequence_id", "offset"])
