import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagweave.llm import huffman, packing
from tagweave.llm.tokens import Encoder, encoder

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [None, "", " ", "a", "Hello, world!  Two  spaces\n\n x", "ß漢😀 <|endoftext|>'s don't 12345", "same", "same", "word " * 5000]


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_library():
    rng, lib, enc = random.Random(5), library(), encoder(PATH)
    made = ["".join(rng.choice("ab 'sé\n\t 1　 \x85$ .,ß漢😀<|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, e in zip(made, lib.encode_batch(made, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.raw(text), "<u4").tolist() == e.ids, repr(text)


def test_line_breaks_and_marks_make_no_chunks_of_their_own():
    """Every pair of words around a break, and every word with its marks, went through the model as a new chunk."""
    words = ["alpha", "béta", "gamma", "漢字", "it's", "v2"]
    texts = [f"so {a}{m}\n{b}{m} so" for a in words for b in words for m in ("", ".", "$$$", "'s", "_(")]
    texts += ["a\n\nb", "\na", "a\n", "a \nb", "\n", "a\r\nb", "a\n b", " a", "a ", "a  b\nc"]
    lib, enc = library(), Encoder(PATH)
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.raw(text), "<u4").tolist() == e.ids, repr(text)
    assert len(enc.first) + len(enc.later) < 100


def expected(rows):
    lib, out, start = library(), [], 0
    for doc, text in sorted(rows):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(docs):
    rows = list(enumerate(TEXTS))
    got = huffman.huffman_round_trip(docs(rows), PATH)
    assert sorted(map(tuple, got.collect())) == expected([(d, t or "") for d, t in rows])


def test_files_empty_table(docs):
    assert huffman.huffman_round_trip(docs([]), PATH).count() == 0


def test_files_hold_ids_and_clashing_columns(docs, spark):
    from pyspark.sql import functions as F

    df = docs([(k, TEXTS[k % len(TEXTS)]) for k in range(90)]).withColumn("ids", F.lit("x")).withColumn("part", F.lit(1)).withColumn("seq", F.lit(1))
    folder = huffman.common.fresh_dir(spark, "test")
    files = huffman.write_token_files(df, folder, PATH, shard_tokens=100)
    assert files.count() > 1
    lib = library()
    for r in huffman.read_token_files(spark, folder, files, with_ids=True).collect():
        assert r.ids == lib.encode(TEXTS[r.doc_id % len(TEXTS)] or "", add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 200), st.integers(1, 10**6), min_size=1, max_size=60), st.integers(6, 18))
def test_code_lengths(counts, limit):
    import heapq

    lengths = huffman.code_lengths(counts, limit)
    assert max(lengths.values()) <= limit and sum(2.0**-k for k in lengths.values()) <= 1
    heap = [(n, i) for i, n in enumerate(counts.values())]
    heapq.heapify(heap)
    cost, free = 0, {i: 0 for i in range(len(heap))}
    groups = {i: [i] for i in free}
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        groups[i] = groups[i] + groups.pop(j)
        for k in groups[i]:
            free[k] += 1
        heapq.heappush(heap, (a + b, i))
    cost = sum(n * lengths[i] for i, n in counts.items())
    best = sum(n * k for n, k in zip(counts.values(), free.values(), strict=True)) if len(counts) > 1 else cost
    assert cost >= best and (max(free.values()) > limit or cost == best)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 64))
def test_coder_round_trip(ids, block):
    lengths = np.zeros(301, np.uint8)
    for i, k in huffman.code_lengths(Counter(ids), 12).items():
        lengths[i] = k
    coder = huffman.Coder(lengths, 12)
    data = huffman.pack(coder, np.asarray([7]), np.asarray([len(ids)]), np.asarray(ids, np.int64), block)
    docs, sizes, back = huffman.unpack(data)
    assert docs.tolist() == [7] and back.tolist() == ids


def plain_bfd(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if b >= length]
            if fits:
                bins.remove(min(fits))
            bins.append((min(fits) if fits else capacity) - length)
    return sorted(bins)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 12), max_size=12))
def test_best_fit_equals_piece_by_piece(counts):
    placements, bins = packing.best_fit_decreasing(counts, 20)
    filled, ranks = defaultdict(list), Counter()
    for length, first, pieces, base, each, offset in placements:
        assert first == ranks[length]
        ranks[length] += pieces
        for k in range(pieces):
            filled[base + k // each].append((offset + k % each * length, length))
    assert ranks == Counter(counts)
    left = []
    for spans in filled.values():
        end = 0
        for at, length in sorted(spans):
            assert at == end
            end += length
        left.append(20 - end)
    assert sorted(left) == plain_bfd(counts, 20) and len(filled) == bins


def test_pack_sequences(docs):
    rows = [*enumerate(TEXTS), *((100 + k, "tok " * (k * 7 % 90)) for k in range(60))]
    got = packing.pack_sequences(docs(rows), PATH, size=64, with_ids=True).collect()
    lib, whole, filled = library(), defaultdict(dict), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length <= 64 and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        assert r.piece == 0 or r.length == 64
        whole[r.doc_id][r.piece] = (r.start, r.ids)
        filled[r.sequence_id].append((r.offset, r.length))
    for doc, text in rows:
        pieces = [whole[doc][k] for k in range(len(whole[doc]))]
        assert [s for s, _ in pieces] == [sum(len(i) for _, i in pieces[:k]) for k in range(len(pieces))]
        assert sum((i for _, i in pieces), []) == lib.encode(text or "", add_special_tokens=False).ids + [2]
    for spans in filled.values():
        end = 0
        for at, length in sorted(spans):
            assert at == end
            end += length
        assert end <= 64
    assert len(filled) == packing.best_fit_decreasing(Counter(r.length for r in got), 64)[1]


def test_pack_empty(docs):
    assert packing.pack_sequences(docs([]), PATH).count() == 0


def test_queries_read_added_tokens_as_the_unchanged_library(spark, docs, tmp_path):
    from tagweave.llm import queries

    lib = Tokenizer.from_file(PATH)
    assert lib.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rows = [(1, "a <|endoftext|> b"), (2, "x<|endoftext|><|endoftext|>"), (3, "plain <|endoftex|> text")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: zlib.crc32(np.asarray(lib.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in queries.op5_token_files(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.ids_crc32 for r in queries.op10_best_fit_packing(spark, str(tmp_path)).collect()} == want
