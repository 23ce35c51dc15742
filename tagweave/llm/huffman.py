"""Token-id files: canonical length-limited Huffman coding (operator 5).

A corpus is written as shard files in ascending ``doc_id`` order. All files share one canonical code,
made from the counts of all ids of all documents and limited to ``LIMIT`` bits by package-merge.

File layout (little-endian): the fixed header ``HEADER``; code lengths by id, one byte each, zlib
compressed; document ids (int64) and token counts (uint32); one 64-bit bit offset for every
``BLOCK`` tokens; the bit string as big-endian 32-bit words, padded with two empty words. Each block
can be decoded alone from its bit offset; the decoder runs all blocks of a file in step by table look-up.

Defined results: null text counts as empty (the document holds the end id alone); repeated rows are
written as often as they occur; a null ``doc_id`` sorts first and reads back as null; an empty table
gives no files and no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import common
from tagweave.llm.tokens import encoder

MAGIC = b"TWHUF1\0\0"
HEADER = struct.Struct("<8sIIIIQQQ")  # magic, vocabulary, limit, block, bytes of lengths, documents, tokens, words
LIMIT, BLOCK = 18, 1024
NULL_ID = -(1 << 63)
SHARD_TOKENS = 1 << 21
#: Chunks of text whose ids a worker remembers.
CHUNKS = 1_200_000


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    items = sorted((n, i) for i, n in counts.items() if n > 0)
    if len(items) < 2:
        return {i: 1 for _, i in items}
    if len(items) > 1 << limit:
        raise ValueError(f"{len(items)} ids do not fit into codes of {limit} bits")
    weights = [n for n, _ in items]
    # A level's list holds leaves (index) and packages of two of the level below; ``leaves`` is how
    # many leaves stand among its first k entries, all that is needed to walk back.
    levels: list[np.ndarray] = []
    below: list[int] = []
    for _ in range(limit):
        packages = [below[k] + below[k + 1] for k in range(0, len(below) - 1, 2)]
        merged = list(heapq.merge(((w, 0) for w in weights), ((w, 1) for w in packages)))
        levels.append(np.cumsum([not kind for _, kind in merged]))
        below = [w for w, _ in merged]
    lengths = np.zeros(len(items), np.int64)
    take = 2 * len(items) - 2
    for leaves in reversed(levels):
        if take == 0:
            break
        own = int(leaves[take - 1])
        lengths[:own] += 1
        take = 2 * (take - own)
    return {i: int(k) for (_, i), k in zip(items, lengths, strict=True)}


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by id for code lengths by id (0: unused): shorter first, then smaller id."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if not lengths[i]:
            continue
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Coder:
    """Encodes and decodes id arrays under one table of code lengths."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.lengths, self.limit = lengths.astype(np.uint8), limit
        self.codes = canonical(self.lengths)
        used = np.flatnonzero(self.lengths)
        self.symbol, self.width = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = (1 << (limit - self.lengths[order].astype(np.int64))).astype(np.int64)
        filled = int(spans.sum())
        self.symbol[:filled] = np.repeat(order, spans)
        self.width[:filled] = np.repeat(self.lengths[order].astype(np.int64), spans)
        self.packed = zlib.compress(self.lengths.tobytes(), 6)

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit words, bit offset of every block)."""
        widths = self.lengths[ids].astype(np.int64)
        if len(widths) and not widths.min():
            raise ValueError("an id without a code")
        ends = np.cumsum(widths)
        at = ends - widths
        total = int(ends[-1]) if len(ends) else 0
        n = (total + 31) // 32 + 2
        value = self.codes[ids] << (64 - widths - (at & 31)).astype(np.uint64)
        word = at >> 5
        # bits of different codes never overlap, so sums are unions, and below 2**53 they are exact
        words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return words.astype(np.uint32), at[::block].astype(np.uint64)

    def decode(self, words: np.ndarray, offsets: np.ndarray, tokens: int, block: int = BLOCK) -> np.ndarray:
        wide = np.zeros(len(words), np.uint64)
        wide[:-1] = (words[:-1].astype(np.uint64) << np.uint64(32)) | words[1:].astype(np.uint64)
        lanes = len(offsets)
        out = np.zeros((lanes, block), np.uint32)
        at, mask = offsets.astype(np.int64), np.uint64((1 << self.limit) - 1)
        last = tokens - (lanes - 1) * block
        for step in range(block):
            if step == last:  # only the last block is short
                at = at[:-1]
            if not len(at):
                break
            peek = (wide[at >> 5] >> (64 - self.limit - (at & 31)).astype(np.uint64)) & mask
            out[: len(at), step] = self.symbol[peek]
            at = at + self.width[peek]
        return out.reshape(-1)[:tokens]


def pack(coder: Coder, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets = coder.encode(ids, block)
    head = HEADER.pack(MAGIC, len(coder.lengths), coder.limit, block, len(coder.packed), len(doc_ids), len(ids), len(words))
    return b"".join((head, coder.packed, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u8").tobytes(), words.astype(">u4").tobytes()))


_coders: dict[tuple[bytes, int], Coder] = {}


def _coder(packed: bytes, limit: int) -> Coder:
    if (packed, limit) not in _coders:
        _coders.clear()
        _coders[packed, limit] = Coder(np.frombuffer(zlib.decompress(packed), np.uint8), limit)
    return _coders[packed, limit]


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, all ids) of one file."""
    magic, _, limit, block, n_packed, docs, tokens, n_words = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    coder = _coder(data[at : at + n_packed], limit)
    at += n_packed
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    sizes = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    blocks = -(-tokens // block)
    offsets = np.frombuffer(data, "<u8", blocks, at)
    at += 8 * blocks
    words = np.frombuffer(data, ">u4", n_words, at)
    return doc_ids, sizes, coder.decode(words.astype(np.uint32), offsets, tokens, block)


class _Tokenise:
    """Rows (part, seq, doc_id, ids) in the order of the partition; ids as unsigned 16 or 32 bits."""

    SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def __init__(self, path: str, end_id: int, special: bool = False):
        self.special = special
        self.path, self.end_id = path, end_id

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(self.path, CHUNKS, self.special), TaskContext.get().partitionId(), 0
        kind = "<u2" if max(enc.size, self.end_id) < 1 << 16 else "<u4"
        end = np.asarray([self.end_id], "<u4").tobytes()
        for batch in common.slices(batches):
            ids = [np.frombuffer(enc.raw(t) + end, "<u4").astype(kind).tobytes() for t in common.texts(batch)]
            n = batch.num_rows
            yield common.table({"part": [part] * n, "seq": range(seq, seq + n), "doc_id": batch.column("doc_id").to_pylist(), "ids": ids}, self.SCHEMA)
            seq += n


class _Count:
    """Partial counts of ids, one row of arrays a task at most for each id of the vocabulary."""

    SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def __init__(self, kind: str):
        self.kind = kind

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in common.slices(batches):
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), self.kind))
            if len(found) > len(counts):
                counts = np.pad(counts, (0, len(found) - len(counts)))
            counts[: len(found)] += found
        used = np.flatnonzero(counts)
        yield common.table({"id": used, "n": counts[used]}, self.SCHEMA)


class _Write:
    """Shard files from rows in order; a file ends where the order breaks or it is full."""

    SCHEMA = pa.schema([("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def __init__(self, packed: bytes, limit: int, kind: str, folder: str, most: int):
        self.packed, self.limit, self.kind, self.folder, self.most = packed, limit, kind, folder, most

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(self.packed, self.limit)
        store, root = pafs.FileSystem.from_uri(self.folder)
        held: list[tuple[int, bytes]] = []
        size, first, due = 0, None, None

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), self.kind).astype(np.uint32)
            sizes = np.asarray([len(x) // np.dtype(self.kind).itemsize for _, x in held])
            name = f"{first[0]:09d}-{first[1]:015d}.tok"
            data = pack(coder, np.asarray([d for d, _ in held], np.int64), sizes, ids)
            temp = f"{root}/_{name}-{np.random.default_rng().integers(1 << 62):x}"  # a second attempt at the task writes its own
            with store.open_output_stream(temp) as f:
                f.write(data)
            store.move(temp, f"{root}/{name}")
            return common.table({"file": [name], "docs": [len(held)], "tokens": [len(ids)]}, self.SCHEMA)

        for batch in common.slices(batches):
            for part, seq, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "ids")), strict=True):
                if held and ((part, seq) != due or size >= self.most):
                    yield flush()
                    held, size = [], 0
                if not held:
                    first = (part, seq)
                held.append((NULL_ID if doc is None else doc, ids))
                size += len(ids) // np.dtype(self.kind).itemsize
                due = (part, seq + 1)
        if held:
            yield flush()


class _Read:
    """Documents of shard files with their place inside the file; with ``ids`` if asked for."""

    SCHEMA = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def __init__(self, with_ids: bool):
        self.with_ids = with_ids

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            doc_ids, sizes, ids = unpack(batch.column("content")[0].as_py())
            ends = np.cumsum(sizes.astype(np.int64))
            starts, flat = ends - sizes, ids.astype("<u4")
            view, n = memoryview(flat).cast("B"), len(doc_ids)
            yield common.table({
                "file": [batch.column("path")[0].as_py().rsplit("/", 1)[-1]] * n, "doc_id": [None if d == NULL_ID else d for d in doc_ids.tolist()],
                "place": starts, "n_tokens": sizes.astype(np.int64),
                "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
                "ids": [flat[a:b].tolist() for a, b in zip(starts, ends, strict=True)] if self.with_ids else [None] * n,
            }, self.SCHEMA)


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int, ordered: bool = True, special: bool = False) -> DataFrame:
    """Encode every text once, ``ordered`` by ``doc_id``; the rows lie in the shared folder."""
    docs = docs.select("doc_id", "text")
    if ordered:
        docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "part int, seq bigint, doc_id bigint, ids binary"
    rows = docs.mapInArrow(_Tokenise(tokenizer_path, end_id, special), schema)
    with common.few_texts(docs.sparkSession):
        return common.materialise(rows, "tokens")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, limit: int = LIMIT, shard_tokens: int = SHARD_TOKENS, special: bool = False) -> DataFrame:
    """Write ``docs`` as token files into ``folder``; one row per file (file, docs, tokens).

    The counts that are collected have one row per id of the vocabulary at most.
    """
    rows = token_rows(docs, tokenizer_path, end_id, special=special)
    size = max(encoder(tokenizer_path).size, end_id + 1)
    kind = "<u2" if max(encoder(tokenizer_path).size, end_id) < 1 << 16 else "<u4"
    counted = rows.select("ids").mapInArrow(_Count(kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    lengths = np.zeros(size, np.uint8)
    for i, k in code_lengths({r.id: r.n for r in counted}, limit).items():
        lengths[i] = k
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    packed = zlib.compress(lengths.tobytes(), 6)
    return common.materialise(rows.mapInArrow(_Write(packed, limit, kind, folder, shard_tokens), "file string, docs bigint, tokens bigint"), "token-files")


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read token files back: doc_id, start (over the whole corpus), n_tokens, ids_crc32, and ids if asked for.

    ``files`` is what ``write_token_files`` returned; names sort in corpus order. The start of each
    partition's first file comes from sums by partition, which are few; within it a window adds up.
    """
    from pyspark.sql import Window

    files = files.dropDuplicates(["file"]).withColumn("part", F.split("file", "-")[0])
    parts = files.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("tokens")
    starts = files.withColumn("inside", inside).join(before, "part").select("file", (F.col("base") + F.col("inside")).alias("base"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.tok").load(folder).select("path", "content")
    docs = raw.mapInArrow(_Read(with_ids), "file string, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>")
    out = docs.join(starts, "file").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def huffman_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, special: bool = False) -> DataFrame:
    """Write token files into the shared folder and return what is read back from them."""
    spark = docs.sparkSession
    folder = common.fresh_dir(spark, "huffman")
    files = write_token_files(docs, folder, tokenizer_path, end_id, special=special)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_token_files(spark, folder, files)
