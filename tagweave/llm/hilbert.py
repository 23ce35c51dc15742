"""Approximate nearest neighbours by shifted space-filling curves (operator 8).

Every different vector is projected at random to ``DIMS`` coordinates, each spread evenly over its range,
shifted, and placed on a Hilbert curve; ``CURVES`` such curves have projections and shifts of their own.
Each curve's order is cut at quantiles into blocks, which Spark partitions by range. On every curve a
query visits the blocks around its own key that together hold ``WINDOW`` of the index; the windows merge
and candidates are ranked by exact distance.

The window is a share of the index and the same at every size, so recall doesn't fall as the index grows:
in vectors without structure near neighbours are hardly nearer on a curve than others, and many small
windows find more of them than a few large ones for the same number of distances. Blocks hold at most
about ``BLOCK_ROWS`` entries, and ``2 (k + 1)`` at least, so that any window has ``k`` neighbours to find.
Means and spreads of the projections and the quantiles come from all vectors.

Curves are run ``AT_ONCE`` at a time: only so many copies of the vectors are in the shuffle at once. A
task holds one block at a time and streams the queries that visit it.

Copies of a vector are one entry of the index with its smallest ``k + 1`` ids, found by ranks within
salted groups, so that a very common vector is neither a large block nor a large group.

Defined results: vectors that are null or zero, or hold null or non-finite components, take no part, and
rows with null ids neither; of rows with the same id each vector is an entry, a query finds none of its
own id; vectors are searched among those of their own length, and the model holds one set of projections
for each length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm import common

CURVES, DIMS, BITS, WINDOW, SALTS = 32, 6, 8, 0.03, 16
BLOCKS, BLOCK_ROWS, AT_ONCE = 100, 20_000, 4
#: Lowest bits of a key that come from the id, so that equal places on a curve can be cut apart.
TIES = 14


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits; by Skilling's
    transposition, all points at once. The key has bits * dimensions <= 63 bits."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(n):
            high = (x[k] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if k:
                x[k] ^= swap
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | ((x[k] >> b) & 1)
    return key


class Curves:
    """Projections and shifts of every length of vector; ``fit`` sets where their coordinates lie."""

    def __init__(self, widths: list[int], curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 11):
        self.bits, self.curves = bits, curves
        self.axes, self.shifts, self.middle, self.spread = {}, {}, {}, {}
        for width in widths:
            rng = np.random.default_rng([seed, width])
            self.axes[width] = np.concatenate([np.linalg.qr(rng.normal(size=(width, min(dims, width))))[0] for _ in range(curves)], 1)
            self.shifts[width] = rng.uniform(0, 1, size=self.axes[width].shape[1])

    def fit(self, width: int, n: int, total: np.ndarray, squares: np.ndarray) -> None:
        self.middle[width] = total / n
        spread = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
        self.spread[width] = np.where(spread > 0, spread, 1.0)

    def keys(self, vectors: np.ndarray, uid: np.ndarray, curves: range | None = None) -> list[np.ndarray]:
        """For each curve the keys: place on the curve, then bits of the id."""
        width = vectors.shape[1]
        dims = self.axes[width].shape[1] // self.curves
        ties = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIES)).astype(np.int64)
        out = []
        for c in range(self.curves) if curves is None else curves:
            own = slice(c * dims, (c + 1) * dims)
            z = (vectors @ self.axes[width][:, own] - self.middle[width][own]) / self.spread[width][own]
            even = 1 / (1 + np.exp(-1.702 * z))  # about the share of a bell curve that lies below
            cell = ((even + self.shifts[width][own]) / 2 * (1 << self.bits)).astype(np.int64)
            out.append(hilbert_keys(np.clip(cell, 0, (1 << self.bits) - 1), self.bits) << TIES | ties)
        return out


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by length of vector: (row numbers, vectors)."""
    column = batch.column("vec")
    sizes = batch.column("width").to_numpy()
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy().astype(float).reshape(-1, width)


class _Moments:
    """Sums and sums of squares of all projections of a task, by length."""

    SCHEMA = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))])
    DDL = "width int, n bigint, total array<double>, squares array<double>"

    def __init__(self, curves: Curves):
        self.curves = curves

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in common.slices(batches):
            for _, vectors in _by_width(batch):
                p = vectors @ self.curves.axes[vectors.shape[1]]
                own = held.setdefault(vectors.shape[1], [0, 0.0, 0.0])
                own[0] += len(p)
                own[1], own[2] = own[1] + p.sum(0), own[2] + (p * p).sum(0)
        rows = [(w, n, a.tolist(), b.tolist()) for w, (n, a, b) in held.items()]
        if rows:
            yield common.table(dict(zip(("width", "n", "total", "squares"), zip(*rows), strict=True)), self.SCHEMA)


class _Keys:
    """(width, curve, key) of every entry on every curve."""

    SCHEMA = pa.schema([("width", pa.int32()), ("curve", pa.int32()), ("key", pa.int64())])

    def __init__(self, curves: Curves):
        self.curves = curves

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            uid = batch.column("uid").to_numpy()
            for rows, vectors in _by_width(batch):
                keys = self.curves.keys(vectors, uid[rows])
                at = np.repeat(np.arange(len(keys), dtype=np.int32), len(rows))
                yield common.table({"width": np.full(len(at), vectors.shape[1], np.int32), "curve": at, "key": np.concatenate(keys)}, self.SCHEMA)


class _Deal:
    """Entries to their blocks on the curves given, and queries (role 1) to all blocks of their windows."""

    def __init__(self, curves: Curves, bounds: dict[tuple[int, int], np.ndarray], first: dict[tuple[int, int], int], own: range, window: float, vec: pa.DataType):
        self.curves, self.bounds, self.first, self.own, self.window = curves, bounds, first, own, window
        self.schema = pa.schema([("block", pa.int64()), ("role", pa.int32()), ("uid", pa.int64()), ("ids", pa.list_(pa.int64())), ("vec", vec)])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            uid, asks = batch.column("uid").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            for rows, vectors in _by_width(batch):
                width = vectors.shape[1]
                for c, keys in zip(self.own, self.curves.keys(vectors, uid[rows], self.own), strict=True):
                    bounds, first = self.bounds[width, c], self.first[width, c]
                    many = len(bounds) + 1
                    nth = np.searchsorted(bounds, keys, "right")
                    yield self._out(batch, rows, first + nth, 0)
                    reach = min(many, max(3, round(many * self.window)))
                    asked = np.flatnonzero(asks[rows])
                    low = np.clip(nth[asked] - reach // 2, 0, many - reach)
                    yield self._out(batch, np.repeat(rows[asked], reach), first + (low[:, None] + np.arange(reach)).ravel(), 1)

    def _out(self, batch, rows, block, role) -> pa.RecordBatch:
        taken = batch.take(pa.array(rows, pa.int64()))
        ids = taken.column("ids") if role == 0 else pa.nulls(len(rows), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.full(len(rows), role, np.int32)), taken.column("uid"), ids, taken.column("vec")], schema=self.schema)


class _Search:
    """Of rows sorted by block and role the ``k`` nearest ids of each query among its block's entries."""

    SCHEMA = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = (run for batch in common.slices(batches) for run in self._runs(batch))
        for _, block in groupby(runs, key=lambda r: r[0]):
            vecs, ids, data = [], [], None
            for _, role, rows in block:
                if role == 0:
                    vecs.append(self._vectors(rows))
                    ids += rows.column("ids").to_pylist()
                    continue
                if data is None:
                    if not vecs:
                        break
                    data = np.concatenate(vecs)
                    owner, flat = np.repeat(np.arange(len(ids)), [len(i) for i in ids]), np.concatenate(ids)
                yield self._nearest(rows.column("uid").to_numpy(), self._vectors(rows), data, owner, flat)

    @staticmethod
    def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        block, role = batch.column("block").to_numpy(), batch.column("role").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (role[1:] != role[:-1])]) if len(block) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(block)], strict=True):
            yield int(block[lo]), int(role[lo]), batch.slice(lo, hi - lo)

    @staticmethod
    def _vectors(rows: pa.RecordBatch) -> np.ndarray:
        return rows.column("vec").flatten().to_numpy().astype(float).reshape(rows.num_rows, -1)

    def _nearest(self, uid, queries, data, owner, flat) -> pa.RecordBatch:
        out = {"uid": [], "vec_id": [], "score": []}
        norms, k = (data * data).sum(1), min(self.k, len(data))
        for at in range(0, len(queries), 256):
            part = queries[at : at + 256]
            rough = (part * part).sum(1)[:, None] + norms[None] - 2 * part @ data.T
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-6 * (1 + np.abs(rough).max(1))
            for row, most, who, q in zip(rough, limit, uid[at : at + 256], part, strict=True):
                # by the rough distance a superset of the k nearest, then the exact one on the vectors
                near = np.flatnonzero(row <= most)
                exact = np.full(len(data), np.inf)
                exact[near] = np.sqrt(((data[near] - q) ** 2).sum(1))
                own = np.flatnonzero(np.isin(owner, near)) if len(flat) > len(data) else near
                best = own[np.lexsort((flat[own], exact[owner[own]]))[: self.k]]
                out["uid"] += [who] * len(best)
                out["vec_id"] += flat[best].tolist()
                out["score"] += exact[owner[best]].tolist()
        return common.table(out, self.SCHEMA)


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """(vec, ids, uid): different vectors with their k smallest ids; uid is the smallest.

    Ranks within salted groups come first, so that no task gets all copies of a common vector.
    """
    by = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    first = rows.withColumn("salt", by).withColumn("r", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("vec_id"))).where(F.col("r") <= k)
    second = first.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= k)
    ids = F.array_sort(F.collect_list("vec_id"))  # at most k
    return second.groupBy("vec").agg(ids.alias("ids")).withColumn("uid", F.element_at("ids", 1))


def nearest(vectors: DataFrame, queries, k: int = 10, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: float = WINDOW, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``vectors`` (vec_id, embedding) for
    which the condition ``queries`` holds, among all others."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    vec = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 becomes 0.0
    sound = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select("vec_id", vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & sound)
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vec")
    wanted = asked.select("vec").distinct().withColumn("asks", F.lit(True))
    index = _smallest_ids(rows, k + 1).join(wanted, "vec", "left").select("uid", "ids", "vec", F.size("vec").alias("width"), F.coalesce("asks", F.lit(False)).alias("asks"))
    index = common.materialise(index, "vectors")
    sizes = {r.width: r.n for r in index.groupBy("width").agg(F.count("*").alias("n")).collect()}
    model = Curves(sorted(sizes), curves, dims, bits, seed)
    moments: dict[int, list] = {}
    for r in index.mapInArrow(_Moments(model), _Moments.DDL).collect():  # one row for each task and length
        own = moments.setdefault(r.width, [0, 0.0, 0.0])
        own[0], own[1], own[2] = own[0] + r.n, own[1] + np.asarray(r.total), own[2] + np.asarray(r.squares)
    for width, (n, total, squares) in moments.items():
        model.fit(width, n, total, squares)
    keys = index.mapInArrow(_Keys(model), "width int, curve int, key bigint")
    bounds: dict[tuple[int, int], np.ndarray] = {}
    for width, n in sizes.items():
        many = max(1, min(BLOCKS, n // (2 * (k + 1))), -(-n // BLOCK_ROWS))
        cuts = F.percentile_approx("key", F.array(*[F.lit(j / many) for j in range(1, many)]), F.lit(max(10_000, 40 * many))) if many > 1 else F.array().cast("array<bigint>")
        for r in keys.where(F.col("width") == width).groupBy("curve").agg(cuts.alias("cuts")).collect():  # one bound for each block
            bounds[width, r.curve] = np.unique(np.asarray(r.cuts, np.int64))
    first, start = {}, 0
    for place in sorted(bounds):
        first[place], start = start, start + len(bounds[place]) + 1
    found = []
    item = pa.list_(pa.float32() if kind == "float" else pa.float64())
    for at in range(0, curves if bounds else 0, AT_ONCE):
        own = range(at, min(curves, at + AT_ONCE))
        dealt = index.mapInArrow(_Deal(model, bounds, first, own, window, item), f"block bigint, role int, uid bigint, ids array<bigint>, vec array<{kind}>")
        dealt = dealt.repartitionByRange("block").sortWithinPartitions("block", "role")
        found.append(common.materialise(dealt.mapInArrow(_Search(k + 1), "uid bigint, vec_id bigint, score double"), "found"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    merged = every.distinct().withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    merged = common.materialise(merged.select("uid", "vec_id", "score"), "merged")
    named = common.materialise(asked.join(index.select("vec", "uid"), "vec").select("query_id", "uid"), "asked")
    both = named.join(merged, "uid").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
