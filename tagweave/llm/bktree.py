"""SimHash near-duplicates with BK-trees over shards of fingerprints (operator 9).

Distinct fingerprints within ``radius`` bits of each other agree in at least one of ``radius + 1``
blocks of bits. Those that agree in a block form a shard, and each shard has a BK-tree: children are
keyed by their Hamming distance to the parent, and a search at distance d follows only the edges
d - radius .. d + radius. A tree goes to the task that searches it, with its shard; trees of the
whole corpus are never broadcast, since they grow with it. A shard of over ``SPLIT`` fingerprints is
split again by blocks of its remaining bits, which is exact for the same reason, so that no task
holds a very large shard unless its fingerprints agree nearly everywhere: different fingerprints that
agree in all blocks but the last few bits are few. A task builds the trees of one large shard or of some
small ones at a time.

Links are reduced to a spanning forest where they are found; components over all shards follow by
large-star and small-star steps.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked
like any other; repeated rows repeat in the result; a row whose ``doc_id`` is null gets a fingerprint
and no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import common
from tagweave.llm.components import connected_components

SEED, SPLIT, TOGETHER = 42, 2000, 200_000
#: Blocks of fewer bits are not worth a split.
LEAST_BITS = 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int16)


def shingle_hashes(text: str, words: int) -> list[int]:
    """Hashes of a text's runs of words, repeats included; ASCII case and white space are folded."""
    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return []
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    if len(split) <= words:
        return [digest(joined, SEED)]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist(), strict=True)
    return [digest(joined[a:b], SEED) for a, b in spans]


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes (unsigned, 64 bits) have."""
    votes = np.zeros(2048, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        part = np.ascontiguousarray(hashes[at : at + (1 << 18)], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.bincount((part + _PLACES).ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", votes.reshape(8, 256), _BITS)
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).astype(np.uint8)).tobytes(), "little")


def simhash(text: str, words: int = 3) -> int:
    """The fingerprint of one text."""
    return fingerprint(np.asarray(shingle_hashes(text, words), np.uint64))


class _Fingerprints:
    SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def __init__(self, words: int):
        self.words = words

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 512):
            fps = np.asarray([simhash(t, self.words) for t in common.texts(batch)], np.uint64).view(np.int64)
            yield common.table({"doc_id": batch.column("doc_id").to_pylist(), "fp": fps}, self.SCHEMA)


class Forest:
    """BK-trees over ``fp``, one for each value of ``shard``, built and searched level by level."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp, n = fp, len(fp)
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left, group = np.arange(n), np.unique(shard, return_inverse=True)[1] if n else np.zeros(0, np.int64)
        parent, edge = self.parent.copy(), self.edge.copy()
        self.root = np.zeros(n, np.int64)
        first_round = True
        while len(left):
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            head = np.r_[True, group[1:] != group[:-1]]
            node = left[head][np.cumsum(head) - 1]  # of each group its first fingerprint becomes the node
            if first_round:
                self.root[left], first_round = node, False
            self.parent[left[head]], self.edge[left[head]] = parent[left[head]], edge[left[head]]
            left, node = left[~head], node[~head]
            parent[left], edge[left] = node, np.bitwise_count(self.fp[left] ^ self.fp[node]).astype(np.int64)
            group = node * 65 + edge[left]
        inner = np.flatnonzero(self.parent >= 0)
        keys = self.parent[inner] * 128 + self.edge[inner]
        order = np.argsort(keys)
        self.keys, self.child = keys[order], inner[order]

    def search(self, radius: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of the same tree within ``radius``, the query being each member in turn."""
        n = len(self.fp)
        work = [(np.arange(a, min(n, a + most // 16)), self.root[a : a + most // 16]) for a in range(0, n, most // 16)]
        while work:
            query, node = work.pop()
            if len(query) > most:
                half = len(query) // 2
                work += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            near = (d <= radius) & (query != node)
            if near.any():
                yield query[near], node[near]
            lo = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 128 + d + radius, "right")
            for a in range(0, len(query), most // 8):
                low, many = lo[a : a + most // 8], (hi - lo)[a : a + most // 8]
                total = int(many.sum())
                if total:
                    at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)
                    work.append((np.repeat(query[a : a + most // 8], many), self.child[at]))


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over arrays: the roots after the links (a, b); a root is its set's smallest member."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return parent
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


class _Links:
    """Spanning forests (u, v) of the links inside the shards of rows (tab, key, fp, node) sorted by shard.

    Small shards are taken together until they have ``TOGETHER`` fingerprints, so a task holds so many or
    one shard.
    """

    SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    COLUMNS = ("tab", "key", "fp", "node")

    def __init__(self, radius: int):
        self.radius = radius

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, most = 0, TOGETHER
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in self.COLUMNS])
            n += batch.num_rows
            if n > most:
                tab, key, fp, node = (np.concatenate(c) for c in zip(*held, strict=True))
                other = np.flatnonzero((tab != tab[-1]) | (key != key[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last shard may go on
                if cut:
                    yield self._forest(tab[:cut], key[:cut], fp[:cut], node[:cut])
                held, n = [[tab[cut:], key[cut:], fp[cut:], node[cut:]]], n - cut
                most = max(TOGETHER, 2 * n)
        if n:
            yield self._forest(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def _forest(self, tab, key, fp, node) -> pa.RecordBatch:
        order = np.argsort(node, kind="stable")
        node, fp = node[order], fp[order].view(np.uint64)
        shard = np.unique(np.stack([tab[order], key[order]], 1), axis=0, return_inverse=True)[1].ravel()
        roots = np.arange(len(node))
        for query, found in Forest(fp, shard).search(self.radius):
            roots = unite(roots, query, found)
        linked = np.flatnonzero(roots != np.arange(len(node)))
        return common.table({"u": node[linked], "v": node[roots[linked]]}, self.SCHEMA)


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    """Bit positions dealt into ``parts`` runs of nearly the same size."""
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _key(bits: list[int]):
    """The value of these bits of ``fp``; they are one run but for what a block took out of it."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def shards(nodes: DataFrame, radius: int, split: int = SPLIT) -> DataFrame:
    """(tab, key, fp, node): every fingerprint in each of its shards; shards of one member are left out.

    Shards of over ``split`` members are cut by blocks of the bits that are left, again and again while
    blocks of at least ``LEAST_BITS`` bits each remain.
    """
    spaces = {0: list(range(64))}  # tab -> the bits in which its members may still differ
    rest = nodes.select("fp", "node", F.lit(0).alias("tab"), F.lit(0).cast("long").alias("key"))
    whole, fresh = None, 1
    while True:
        arrays, below = [], {}
        for tab, bits in spaces.items():
            blocks = _blocks(bits, radius + 1)
            fixed = [b for b in range(64) if b not in bits]  # in them the members of a shard agree
            arrays.append(F.when(F.col("tab") == tab, F.array(*[F.struct(F.lit(fresh + k).alias("tab"), _key(b + fixed).alias("key")) for k, b in enumerate(blocks)])))
            below |= {fresh + k: [x for x in bits if x not in b] for k, b in enumerate(blocks)}
            fresh += len(blocks)
        cut = common.materialise(rest.select("fp", "node", F.inline(F.coalesce(*arrays))), "shards")
        sizes = common.materialise(cut.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        joined = cut.join(sizes, ["tab", "key"])
        large = [t for (t,) in sizes.where(F.col("n") > split).select("tab").distinct().collect() if len(below[t]) // (radius + 1) >= LEAST_BITS]
        again = F.col("tab").isin(large) & (F.col("n") > split) if large else F.lit(False)
        done = joined.where(~again).select("tab", "key", "fp", "node")
        whole = done if whole is None else whole.unionByName(done)
        if not large:
            return whole
        rest, spaces = joined.where(again).select("fp", "node", "tab", "key"), {t: below[t] for t in large}


def near_links(nodes: DataFrame, radius: int = 3, split: int = SPLIT) -> DataFrame:
    """Links (u, v) of nodes that join all fingerprints (fp, node) within ``radius`` bits, directly or by others."""
    dealt = shards(nodes, radius, split).repartition("tab", "key").sortWithinPartitions("tab", "key")
    return dealt.mapInArrow(_Links(radius), "u bigint, v bigint")


def simhash_components(docs: DataFrame, radius: int = 3, words: int = 3, split: int = SPLIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = common.materialise(docs.select("doc_id", "text").mapInArrow(_Fingerprints(words), "doc_id bigint, fp bigint"), "fingerprints")
    nodes = common.materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = common.materialise(connected_components(near_links(nodes, radius, split)), "components")
    named = common.materialise(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
