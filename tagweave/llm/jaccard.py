"""Groups of texts whose sets of word shingles have a Jaccard likeness of ``least`` or more, exactly.

With a ``radius``, SimHash links come first and hold as they are (operator 9's relation, on sets): texts whose fingerprints
differ in so many bits or fewer are one group. Few pairs at a likeness of 0.8 are that near (they differ in 4 to 16 of 64
bits, for which no block of bits is left to shard by), so an exact join adds the links of likeness: two sets with likeness t share one
of their first n - ceil(t n) + 1 shingles in any order that is common to all sets (prefix filter), the
first that they share leaves enough room behind it (positional filter), and they differ in at least as many shingles as the
parities of their shingles by ``BITS`` places differ (bitmap filter). Long sets, which these parities don't tell apart, have longer
prefixes and must share several of them (``shared``), since the pairs of long texts that have some shingle in common grow with the square
of their number. The order puts shingles last that a sample of texts has often, so that common lines bring few candidates; the sample
decides the cost alone, not what is found.

Texts with the same set are one node. In each of the first ``ROUNDS`` rounds a node is verified with one node of another group:
of the few sets in the middle of those it shares a shingle with, the one whose parities are nearest; what is alike is joined. So near
copies meet round the text that they come from. In the last round every pair that passes the filters and
still lies in different groups is verified. To be verified, texts go to one of their pair; one with very many partners has several places.

Defined results: ASCII case and white space are folded; a text of fewer words than a shingle has one, the
whole; texts without words are alike; rows without ``doc_id`` get no group; repeated rows repeat, and of rows
that share an id each has the group of its own text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import bktree, common
from tagweave.llm.components import connected_components

SAMPLE, OFTEN, COMMON = 5_000, 3, 200_000  # they set the order of shingles, which changes the cost alone
PARTNERS = 500  # that one place takes before another is opened
BITS, ROUNDS, MIDDLE, SEEN = 512, 2, 8, 4096  # MIDDLE sets stand for those of one shingle, found from SEEN of them; they change the cost alone
LONG, EACH = 512, 64  # sets of LONG shingles or more must share one for each EACH of them, which changes the cost alone
SPOTS = 1 << 24  # hashes of ids by which texts that nothing asks for are passed over; more ids than that change the cost alone


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted different hashes of a text's runs of words."""
    return np.unique(np.asarray(bktree.shingle_hashes(text, words), np.uint64).view(np.int64))


def name_of(found: np.ndarray) -> int:
    """A hash that names a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), bktree.SEED)).astype(np.int64))


class _Prefixes:
    """doc_id, the name and size of the set, its fingerprint, its parities, and its prefix."""

    SCHEMA = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bits", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
    DDL = "doc_id bigint, sig bigint, n int, fp bigint, bits array<bigint>, items array<bigint>"

    def __init__(self, words: int, least: float, often):
        self.words, self.least, self.often = words, least, often

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = self.often.value
        for batch in common.slices(batches, 256):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                hashes = np.asarray(bktree.shingle_hashes(text, self.words), np.uint64)
                found = np.unique(hashes.view(np.int64))
                # of the set, not of the text, so that equal sets have equal fingerprints
                fp = int(np.uint64(bktree.fingerprint(found.view(np.uint64))).astype(np.int64))
                rows.append((doc_id, name_of(found), len(found), fp, parities(found).tolist(), prefix(found, self.least, often).tolist()))
            if rows:
                yield common.table(dict(zip(self.SCHEMA.names, zip(*rows), strict=True)), self.SCHEMA)


class _Items:
    """The sets themselves, one row for each shingle that a text has."""

    SCHEMA = pa.schema([("token", pa.int64())])

    def __init__(self, words: int):
        self.words = words

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            for text in common.texts(batch):
                yield common.table({"token": shingles(text, self.words)}, self.SCHEMA)


def prefix(found: np.ndarray, least: float, often: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The first shingles in the common order; ``shared`` of them are in the prefix of every set that is alike."""
    if not len(found):
        return found
    rank = np.zeros(len(found), np.int64)
    if often is not None and len(often[0]):
        at = np.minimum(np.searchsorted(often[0], found), len(often[0]) - 1)
        rank = np.where(often[0][at] == found, often[1][at], 0)
    return found[np.lexsort((found, rank))][: len(found) - math.ceil(least * len(found) - 1e-9) + int(shared(np.asarray(len(found)), least))]


def shared(n: np.ndarray, least: float) -> np.ndarray:
    """How many shingles the prefixes of alike sets have in common, for sets of n; of two sizes the smaller number holds.

    Alike sets share ceil(least n) at least for the n of either, and the rest behind a prefix has all of these but so many.
    """
    return np.where(n < LONG, 1, np.maximum(1, np.minimum(1 + n // EACH, np.ceil(least * n - 1e-9)))).astype(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` places whether an odd number of the set's hashes fall there, packed.

    A shingle that one of two sets has and the other has not changes one place, so two sets differ in as many
    shingles as in places, at least.
    """
    return np.packbits((np.bincount(found & (BITS - 1), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    if name == "bits":
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, BITS // 64)
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by the first column as whole groups of it, several in a chunk: columns with ``starts`` of the groups."""
    rest = {c: np.zeros((0, BITS // 64) if c == "bits" else 0, np.int64) for c in names}
    for batch in _with_end(batches):
        if batch is not None:
            rest = {c: np.concatenate([rest[c], _column(batch, c)]) for c in names}
        key = rest[names[0]]
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        done = len(key) if batch is None else int(starts[-1])
        if done:
            yield {c: v[:done] for c, v in rest.items()} | {"starts": starts[starts < done]}
            rest = {c: v[done:] for c, v in rest.items()}


def _with_end(batches):
    yield from batches
    yield None


class _Shared:
    """Of rows (token, at, sig, n) sorted by token those whose token another set has as well."""

    NAMES = ("token", "at", "sig", "n")
    SCHEMA = pa.schema([("token", pa.int64()), ("at", pa.int32()), ("sig", pa.int64()), ("n", pa.int32())])
    DDL = "token bigint, at int, sig bigint, n int"

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, self.NAMES):
            sizes = np.diff(np.r_[g["starts"], len(g["token"])])
            keep = np.repeat(sizes > 1, sizes)
            if keep.any():
                yield common.table({c: g[c][keep] for c in self.NAMES}, self.SCHEMA)


class _Pairs:
    """Pairs (a, b) of different groups that may be alike, of rows (token, at, sig, n, comp, bits) sorted by token. Across: all
    such pairs, with the number k of shingles met here, the number that it ``need``s in all, and in c whether one of these leaves
    enough room behind it (1 or 0). Else for each set b the likeliest a of those in the middle, with an estimate c of their likeness."""

    NAMES = ("token", "at", "sig", "n", "comp", "bits")
    SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("k", pa.int64()), ("need", pa.int64())])
    DDL = "a bigint, b bigint, c bigint, k bigint, need bigint"

    def __init__(self, least: float, across: bool):
        self.least, self.across = least, across

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for g in _groups(batches, self.NAMES):
            g["bits"] = g["bits"].view(np.uint64)  # of negative numbers NumPy counts the bits of the absolute value
            g["need"] = shared(g["n"], self.least) if self.across else np.ones_like(g["n"])
            starts, size = g.pop("starts"), len(g["token"])
            sizes = np.diff(np.r_[starts, size])
            mixed = np.maximum.reduceat(g["comp"], starts) != np.minimum.reduceat(g["comp"], starts)
            large = mixed & (sizes > 2 * MIDDLE)
            small = np.repeat(mixed & ~large, sizes)
            parts = [self._small({c: v[small] for c, v in g.items()})]
            parts += [self._large({c: v[lo:hi] for c, v in g.items()}) for lo, hi in zip(starts[large].tolist(), (starts + sizes)[large].tolist(), strict=True)]
            for pairs in itertools.chain.from_iterable(parts):
                found.append(pairs)
                held += len(pairs[0])
                if held > 1 << 18:
                    yield self._out(found)
                    found, held = [], 0
        if held:
            yield self._out(found)

    def _out(self, found):
        a, b, c, need = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-c, b, a))
        a, b, c, need = a[order], b[order], c[order], need[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return common.table({"a": a[first], "b": b[first], "c": c[first], "k": np.diff(np.r_[first, len(a)]), "need": need[first]}, self.SCHEMA)

    def _likeness(self, g: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Millionths, as the parities have it, for pairs of rows, -1 of pairs that can't be alike or are of one group; and how
        many shingles they must share. Of several the first alone has the room behind it: across, c is 1 or 0 for that."""
        ni, nj, both = g["n"][i], g["n"][j], g["n"][i] + g["n"][j]
        can = (g["comp"][i] != g["comp"][j]) & (np.minimum(ni, nj) >= self.least * np.maximum(ni, nj) - 1e-9)
        room = np.minimum(ni - g["at"][i], nj - g["at"][j]) >= self.least / (1 + self.least) * both - 1e-9
        need = np.minimum(g["need"][i], g["need"][j])
        can &= room | (need > 1)
        out, k = np.full(len(can), -1), np.flatnonzero(can)
        both, apart = both[k], np.bitwise_count(g["bits"][i[k]] ^ g["bits"][j[k]]).sum(1, dtype=np.int64)
        value = room[k].astype(np.int64) if self.across else 1_000_000 - 1_000_000 * apart // np.maximum(both, 1)
        out[k] = np.where(apart <= (1 - self.least) / (1 + self.least) * both + 1e-9, value, -1)
        return out, need

    def _small(self, g: dict) -> Iterator[tuple[np.ndarray, ...]]:
        """Many groups at once: rows are compared with the next, those after the next, and so on."""
        token, n, sig = g["token"], g["n"], g["sig"]
        best, partner = np.full(len(n), -1), np.full(len(n), -1)
        for step in range(1, 2 * MIDDLE):
            i = np.flatnonzero(token[step:] == token[:-step])
            if not len(i):
                break
            c, need = self._likeness(g, i, i + step)
            i, c, need = i[c >= 0], c[c >= 0], need[c >= 0]
            j = i + step
            if self.across and len(i):
                less = (n[i] < n[j]) | (n[i] == n[j]) & (sig[i] < sig[j])
                yield sig[np.where(less, i, j)], sig[np.where(less, j, i)], c, need
            for x, y in (i, j), (j, i):
                better = c > best[x]
                best[x[better]], partner[x[better]] = c[better], y[better]
        b = np.flatnonzero(partner >= 0)
        if not self.across and len(b):
            yield sig[partner[b]], sig[b], best[b], g["need"][b]

    def _large(self, g: dict) -> Iterator[tuple[np.ndarray, ...]]:
        order = np.lexsort((g["sig"], g["n"]))
        g = {c: v[order] for c, v in g.items()}
        sig, n, comp = g["sig"], g["n"], g["comp"]
        kinds, size = np.unique(comp, return_counts=True)
        main = comp == kinds[size.argmax()]

        def like(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            j = np.arange(np.searchsorted(n, self.least * n[i] - 1e-9), np.searchsorted(n, n[i] / self.least + 1e-9, "right"))
            if self.across:
                j = j[main[j] | (j < i)]
            c, need = self._likeness(g, np.full(len(j), i), j)
            return j[c >= 0], c[c >= 0], need[c >= 0]

        if self.across:
            for i in np.flatnonzero(~main).tolist():
                j, c, need = like(i)
                if len(j):
                    yield sig[np.minimum(i, j)], sig[np.maximum(i, j)], c, need
            return
        best, partner = np.full(len(n), -1), np.full(len(n), -1)
        for i in np.r_[_middle(g["bits"], main), _middle(g["bits"], ~main)].tolist():
            j, c, _ = like(i)
            better = c > best[j]
            best[j[better]], partner[j[better]] = c[better], i
        b = np.flatnonzero(partner >= 0)
        if len(b):
            yield sig[partner[b]], sig[b], best[b], g["need"][b]


def _middle(bits: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of ``MIDDLE`` sets that are nearest to the parities that most of these sets have."""
    places = np.flatnonzero(of)
    if len(places) <= MIDDLE:
        return places
    seen = np.unpackbits(bits[places[:: -(-len(places) // SEEN)]].view(np.uint8), axis=1)
    most = np.packbits(2 * seen.sum(0, dtype=np.int64) > len(seen)).view(np.uint64)
    return places[np.argsort(np.bitwise_count(bits[places] ^ most).sum(1, dtype=np.int64), kind="stable")[:MIDDLE]]


class _Wanted:
    """Of rows (doc_id, text, spot) those whose spot is among the wanted."""

    DDL = "doc_id bigint, text string"

    def __init__(self, spots):
        self.spots = spots

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = self.spots.value
        for batch in common.slices(batches, 512):
            at = batch.column("spot").to_numpy(zero_copy_only=False)
            yield batch.select(["doc_id", "text"]).filter(pa.array((spots[at >> 3] >> (at & 7) & 1).astype(bool)))


class _Verify:
    """Links (u, v) of rows (place, role, sig, text) sorted by place and role: the sets of role 1 that are
    alike that of role 0. One set is held at a time; texts of other sets (of rows that share an id) are passed over."""

    SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def __init__(self, words: int, least: float):
        self.words, self.least = words, least

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, head = None, np.zeros(0, np.int64), None
        for batch in common.slices(batches, 256):
            u, v = [], []
            for where, role, sig, text in zip(*(batch.column(c).to_pylist() for c in ("place", "role", "sig")), common.texts(batch), strict=True):
                found = shingles(text, self.words)
                if name_of(found) != sig:
                    continue
                if role == 0:
                    place, first, head = where, found, sig
                elif where == place:
                    both = len(np.intersect1d(first, found, assume_unique=True))
                    if both >= self.least * (len(first) + len(found) - both) - 1e-9:
                        u.append(head), v.append(sig)
            yield common.table({"u": u, "v": v}, self.SCHEMA)


def _order(docs: DataFrame, words: int):
    """Shingles that a sample has often, sorted, with their counts."""
    n = max(1, docs.count())
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * SAMPLE / n).select("text").dropDuplicates()
    often = sample.mapInArrow(_Items(words), "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(COMMON).collect()
    token = np.asarray([r.token for r in often], np.int64)
    order = np.argsort(token)
    return docs.sparkSession.sparkContext.broadcast((token[order], np.asarray([r.n for r in often], np.int64)[order]))


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame:
    """Of pairs (a, b) of sets by name those that are alike, as links (u, v)."""
    pairs = common.materialise(pairs.distinct(), "pairs")
    many = common.materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("places")), "places")
    heads = many.select(F.col("a").alias("sig"), F.lit(0).alias("role"), F.explode(F.transform(F.sequence(F.lit(0), F.col("places") - 1), lambda k: F.xxhash64("a", k))).alias("place"))
    salt = F.pmod(F.xxhash64("b"), F.col("places")).cast("int")
    rest = pairs.join(many.hint("merge"), "a").select(F.col("b").alias("sig"), F.lit(1).alias("role"), F.xxhash64("a", salt).alias("place"))
    # a text comes from the row with the smallest id of its set
    wanted = common.materialise(heads.unionByName(rest).join(nodes.select("sig", F.col("node").alias("doc_id")).hint("merge"), "sig"), "wanted")
    texts = _texts(docs, wanted).join(wanted.hint("merge"), "doc_id").select("place", "role", "sig", "text")
    links = texts.repartition("place").sortWithinPartitions("place", "role").mapInArrow(_Verify(words, least), "u bigint, v bigint")
    with common.few_texts(docs.sparkSession):
        found = common.materialise(links, "alike")
    common.discard(pairs, many, wanted)
    return found


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of the wanted rows and a few more, without a shuffle; a map of at most ``SPOTS`` bits is broadcast."""
    spark, spot = docs.sparkSession, F.pmod(F.xxhash64("doc_id"), F.lit(SPOTS))
    spots = np.zeros(SPOTS // 8, np.uint8)
    for k, found in wanted.select((spot + 1).alias("x")).groupBy(F.bitmap_bucket_number("x")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x"))).collect():
        spots[(k - 1) * 4096 : k * 4096] = np.frombuffer(found, np.uint8)
    return docs.select("doc_id", "text", spot.alias("spot")).mapInArrow(_Wanted(spark.sparkContext.broadcast(spots)), _Wanted.DDL)


def jaccard_components(docs: DataFrame, least: float = 0.8, words: int = 5, radius: int | None = None) -> DataFrame:
    """(doc_id, component_id) of every row with an id: the smallest id of its group.

    Groups are those of the Jaccard likeness alone, or with a ``radius`` of SimHash links within so many bits as well.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    sets = docs.mapInArrow(_Prefixes(words, least, _order(docs, words)), _Prefixes.DDL)
    with common.few_texts(docs.sparkSession):
        sets = common.materialise(sets, "prefixes")
    nodes = common.materialise(sets.groupBy("sig").agg(F.min("doc_id").alias("node"), *[F.any_value(c).alias(c) for c in ("n", "fp", "bits", "items")]), "nodes")
    rows = nodes.select("sig", "n", F.posexplode("items").alias("at", "token")).select("token", "at", "sig", "n")
    tokens = common.materialise(rows.repartition("token").sortWithinPartitions("token").mapInArrow(_Shared(), _Shared.DDL), "tokens")

    tables = [common.materialise(_near(nodes, radius), "near")]
    every = None
    for across in (*[False] * ROUNDS, True):
        every = _components(tables)
        named = nodes.select("sig", "bits").join(every.hint("merge"), "sig", "left").select("sig", F.coalesce("component", "sig").alias("comp"), "bits")
        grouped = tokens.join(named.hint("merge"), "sig").select(*_Pairs.NAMES).repartition("token").sortWithinPartitions("token")
        pairs = grouped.mapInArrow(_Pairs(least, across), _Pairs.DDL)
        if across:
            pairs = pairs.groupBy("a", "b").agg(F.sum("k").alias("k"), F.max("need").alias("need"), F.max("c").alias("c")).where("k >= need and c = 1")
        else:
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
        tables.append(_alike(pairs.select("a", "b"), docs, nodes, words, least))
        common.discard(every)
    common.discard(tokens)
    every = _components(tables)
    common.discard(*tables)
    named = nodes.select("sig", "node").join(every.hint("merge"), "sig", "left").select("sig", "node", F.coalesce("component", "sig").alias("group"))
    named = common.materialise(named, "named")
    smallest = named.groupBy("group").agg(F.min("node").alias("component_id"))
    groups = common.materialise(named.join(smallest.hint("merge"), "group").select("sig", "component_id"), "groups")
    return sets.select("doc_id", "sig").join(groups.hint("merge"), "sig").select("doc_id", "component_id")


def _near(nodes: DataFrame, radius: int | None) -> DataFrame:
    """Links (u, v) that join all sets whose fingerprints are within ``radius`` bits, directly or by others."""
    if radius is None:
        return nodes.select(F.col("sig").alias("u"), F.col("sig").alias("v")).limit(0)
    first = common.materialise(nodes.groupBy("fp").agg(F.min("sig").alias("node")), "fingerprints")
    same = nodes.select("fp", "sig").join(first.hint("merge"), "fp").where("sig <> node")
    return bktree.near_links(first, radius).unionByName(same.select(F.col("sig").alias("u"), F.col("node").alias("v")))


def _components(links: list[DataFrame]) -> DataFrame:
    """(sig, component) of the sets in these links."""
    whole = links[0]
    for more in links[1:]:
        whole = whole.unionByName(more)
    return common.materialise(connected_components(whole).withColumnRenamed("node", "sig"), "components")
