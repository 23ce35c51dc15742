import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagweave.llm import bktree
from tagweave.llm.components import connected_components


def plain_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(fps):
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d, _ in fps}


def test_simhash():
    for t in ["", " \n", "A", "a b", "Ä b C", "the cat sat", "the cat  sat\ton the MAT the cat sat", "\xa0x y z", "w " * 3000]:
        assert bktree.simhash(t) == plain_simhash(t), t


@pytest.mark.parametrize(("split", "together"), [(2000, 200_000), (3, 200_000), (2000, 8)])
def test_components_equal_brute_force(docs, monkeypatch, split, together):
    monkeypatch.setattr(bktree, "TOGETHER", together)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "   ")]
    for k in range(3, 140):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(text)))
    want = plain_components([(d, plain_simhash(t or "")) for d, t in rows])
    got = bktree.simhash_components(docs(rows).withColumn("fp", F.lit("x")).withColumn("node", F.lit(1)), split=split).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.fingerprint == f"{plain_simhash(dict(rows)[r.doc_id] or ''):016x}" for r in got)
    assert len(set(want.values())) < 100


def test_forest_finds_every_pair_within_radius():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fp = np.unique(np.concatenate([fp, *[fp ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for _ in range(4)]]))
    shard = rng.integers(0, 3, len(fp))
    got = {(int(a), int(b)) for q, n in bktree.Forest(fp, shard).search(3, most=64) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert got == want and want


def test_null_ids_repeats_and_empty(docs):
    got = bktree.simhash_components(docs([(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "x y z")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (5, 5), (5, 5), (9, 9)]
    assert bktree.simhash_components(docs([])).count() == 0


def test_connected_components_of_a_path(spark):
    n = 40
    got = connected_components(spark.createDataFrame([(k, k + 1) for k in range(1, n)] + [(100, 101), (7, 7)], "u bigint, v bigint")).collect()
    assert {(r.node, r.component) for r in got} == {(k, 1) for k in range(1, n + 1)} | {(100, 100), (101, 100)}


def test_forests_of_streamed_shards_equal_those_of_whole_partitions(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 9, 300))
    fp = rng.integers(0, 1 << 10, 300)
    rows = {"tab": np.zeros(300, np.int32), "key": key, "fp": fp, "node": rng.permutation(300)}
    table = pa.table(rows)

    def links(together, size):
        monkeypatch.setattr(bktree, "TOGETHER", together)
        found = [b for b in bktree._Links(1)(iter(table.to_batches(max_chunksize=size)))]
        root = np.arange(300)
        for b in found:
            root = bktree.unite(root, b.column("u").to_numpy(), b.column("v").to_numpy())
        return root.tolist()

    assert links(1 << 30, 1000) == links(1, 7) == links(50, 20)
