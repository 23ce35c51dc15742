import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tagweave.llm import simhash


def texts_of(n, seed=1):
    rng = random.Random(seed)
    out = [" ".join(rng.choice("ab cd efg hij klé mnop q r stu".split()) + str(rng.randrange(300)) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return [*out, "", None, "x", "two words", "  a\n b\tc  ", "w " * 30000, out[0], "ß漢😀 é"]


def expected(spark, rows):
    """Edited texts and fingerprints by plain loops; the hash of a term is taken from Spark."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    pairs = [(d, t, rows[(k + 1) % len(rows)][1]) for k, (d, t) in enumerate(rows)]
    edited = {d: t[: len(t) - len(t) // 2] + n[: len(t) // 2] for d, t, n in pairs}
    grams = lambda t: [tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if (w := t.lower().split()) else []
    every = sorted({g for t in [*edited.values(), *(t for _, t in rows)] for g in grams(t)})
    df = spark.createDataFrame([(k, *g, *[None] * (3 - len(g))) for k, g in enumerate(every)], "k int, a string, b string, c string")
    hashes = {every[r.k]: r.h for r in df.select("k", F.xxhash64("a", "b", "c").alias("h")).collect()}

    def fp(t):
        votes = [0] * 64
        for g in grams(t):
            n = min(sum(map(len, g)), simhash.HEAVIEST)
            for b in range(64):
                votes[b] += n if hashes[g] >> b & 1 else -n
        return sum((v > 0) << b for b, v in enumerate(votes))

    own = {d: fp(t) for d, t in rows}
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    out = {}
    for k, (d, t) in enumerate(rows):
        e = fp(edited[d])
        out[d] = (len(t), hashlib.sha256(edited[d].encode()).hexdigest(), f"{own[d]:016x}", f"{e:016x}", like(own[d], e), like(own[d], own[rows[(k + 1) % len(rows)][0]]))
    return out


@pytest.mark.parametrize("step", [1, 1000003])
def test_equals_brute_force(spark, docs, step):
    rows = [(k * step, t) for k, t in enumerate(texts_of(80))]
    got = simhash.edited_pairs(docs(rows).withColumn("cell", F.lit("x")).withColumn("rank", F.lit(0))).collect()
    want = expected(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_one_row_null_ids_and_empty(docs):
    (r,) = simhash.edited_pairs(docs([(4, "ab")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"aa").hexdigest()
    got = simhash.edited_pairs(docs([(None, "x y z"), (3, "same text here"), (3, "same text here"), (9, "q")])).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert simhash.edited_pairs(docs([])).count() == 0


def test_plan_is_native(docs):
    plan = simhash.fingerprints(docs([(1, "a")]), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("split", [2000, 4])
def test_block_tables_find_every_pair(spark, split):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(20)}
    fps |= {f ^ (1 << rng.randrange(64)) for f in list(fps) for _ in range(3)}
    fps |= {f ^ (1 << rng.randrange(64)) for f in list(fps)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b, r.distance) for r in simhash.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp bigint"), split=split).collect()}
    want = {(a, b, d) for a in signed for b in signed if a < b and (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 3}
    assert got == want and want


def test_successors_of_outlying_repeated_and_null_ids(docs):
    rng = random.Random(8)
    ids = [*range(20), 10**15, -(10**15), *[7] * 25, *[None] * 12]
    rows = [(d, f"text {k} {rng.randrange(9)}") for k, d in enumerate(ids)]
    df = docs(rows, parts=5)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = sorted((str(d), t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order))
    out = simhash.with_next(df).collect()
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in out) == want
    at = {(r.cell, r["rank"]): r for r in out}
    assert len(at) == len(rows) and all(at[r.next_cell, r.next_rank].text == r.next_text for r in out)


def test_cells_hold_about_equal_numbers(docs, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 10)
    ids = [5] * 300 + [10**12] + list(range(100))
    out = simhash.with_next(docs([(d, f"t{k}") for k, d in enumerate(ids)]))
    assert max(r["count"] for r in out.groupBy("cell").count().collect()) < 100
