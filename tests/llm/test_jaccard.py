import random

from tagweave.llm import jaccard


def plain(rows, least=0.8, words=5):
    def of(text):
        w = (text or "").lower().split()
        return {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets, root = [(d, of(t)) for d, t in rows], {d: d for d, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a == b or len(a & b) >= least * len(a | b):
                u, v = find(d), find(e)
                root[max(u, v)] = min(u, v)
    return {d: find(d) for d in root}


def test_groups_equal_brute_force(docs):
    rng = random.Random(3)
    line = "all of these pages have one very common line at their end"
    rows = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b")]
    for k in range(40):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(copy) + (" " + line) * (k % 2)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(rows)).collect()}
    want = plain(rows)
    assert got == want and 20 < len(set(want.values())) < len(rows) - 20


def test_pipeline_drops_near_copies_with_edited_words(spark, docs):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    near = [*words[:50], "other", *words[51:100], "word", *words[101:]]  # 186 of 206 shingles in common
    got = corpus_pipeline.near_dedup(spark, docs([(1, " ".join(words)), (2, " ".join(near)), (3, "quite another text"), (None, "x")]), "").collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 3, None]


def test_repeated_ids_null_ids_clashing_columns_and_empty(docs):
    from pyspark.sql import functions as F

    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long), (5, "something else altogether"), (5, long), (7, long + " more"), (None, long), (3, "something else altogether")]
    df = docs(rows).withColumn("sig", F.lit("x")).withColumn("place", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 5)]
    assert jaccard.jaccard_components(docs([])).count() == 0


def test_large_groups_of_near_copies_take_several_places(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTNERS", 5)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    got = {r.component_id for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert got == {0} == set(plain(rows).values())


def test_large_group_of_near_copies_is_verified_round_its_middle(docs, monkeypatch):
    """Copies with one word changed are alike their source; two of them are not (62 of 82 shingles or so)."""
    rng = random.Random(4)
    base, rows = [f"w{k}" for k in range(76)], []
    for k in range(200):
        copy = list(base)
        copy[5 + k % 66] = f"x{rng.random()}"
        rows.append((k + 1, " ".join(copy)))
    rows.append((500, " ".join(base)))
    seen, alike = [], jaccard._alike
    monkeypatch.setattr(jaccard, "_alike", lambda pairs, *rest: seen.append(pairs.distinct().count()) or alike(pairs, *rest))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert got == plain(rows) and set(got.values()) == {1}
    assert sum(seen) <= 3 * len(rows), seen


def test_pairs_that_may_be_alike_are_all_found_in_small_and_large_groups():
    import itertools

    import numpy as np
    import pyarrow as pa

    rng, sets = random.Random(8), []
    for size in [2] * 30 + [60]:
        base = [f"w{rng.random()}" for _ in range(rng.randint(6, 200))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            sets.append(jaccard.shingles(" ".join(copy), 5))
    apart = [int(np.bitwise_count((jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64)).sum()) for a, b in itertools.combinations(sets, 2)]
    assert all(d <= len(np.setxor1d(a, b)) for d, (a, b) in zip(apart, itertools.combinations(sets, 2), strict=True)) and max(apart) > 200
    rows = sorted((t, at, k, len(s), k, jaccard.parities(s).tolist()) for k, s in enumerate(sets) for at, t in enumerate(jaccard.prefix(s, 0.8, None).tolist()))
    schema = pa.schema([("token", pa.int64()), ("at", pa.int32()), ("sig", pa.int64()), ("n", pa.int32()), ("comp", pa.int64()), ("bits", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    found = {frozenset(p) for out in jaccard._Pairs(0.8, True)(iter([batch.slice(0, 700), batch.slice(700)])) for p in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
    alike = {frozenset((i, j)) for i, j in itertools.combinations(range(len(sets)), 2) if (both := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)}
    assert alike <= found and 100 < len(alike) and len(found) < 2 * len(alike)


def test_pipeline_keeps_the_links_of_simhash(spark, docs):
    """These texts are one bit to three apart at a likeness of 0.78."""
    import corpus_pipeline
    import numpy as np

    from tagweave.llm import bktree

    rng = random.Random(444)
    words = [f"w{rng.randrange(1000)}" for _ in range(60)]
    near = list(words)
    for k in range(2):
        near[rng.randrange(8, 50)] = f"x{k}"
    texts = " ".join(words), " ".join(near)
    (a, b), (x, y) = (jaccard.shingles(t, 5) for t in texts), (bktree.fingerprint(jaccard.shingles(t, 5).view(np.uint64)) for t in texts)
    assert len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)) and (x ^ y).bit_count() <= 3
    rows = [(1, texts[0]), (2, texts[1]), (3, "quite another text of a few words more")]
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(rows)).collect()} == {1: 1, 2: 2, 3: 3}
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()) == [1, 3]


def test_long_texts_that_share_a_few_shingles_are_not_verified(docs, monkeypatch):
    """Each two of these have a phrase in common, and their 512 parities can't tell such long sets apart."""
    rng, n = random.Random(12), 30
    phrases = {(i, j): " ".join(f"p{rng.random()}" for _ in range(7)) for i in range(n) for j in range(i)}
    rows = []
    for k in range(n):
        own = [p for pair, p in phrases.items() if k in pair] + [f"w{rng.random()}" for _ in range(1200)]
        rng.shuffle(own)
        rows.append((k + 1, " ".join(own)))
    near = rows[0][1].split()
    for k in range(0, len(near), 60):
        near[k] = "x"
    rows.append((100, " ".join(near)))
    seen, alike = [], jaccard._alike
    monkeypatch.setattr(jaccard, "_alike", lambda pairs, *rest: seen.append(pairs.distinct().count()) or alike(pairs, *rest))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert got == plain(rows) and got[100] == 1
    assert seen[-1] <= 3, seen  # 150 or more if one shingle is enough


def test_alike_long_sets_share_as_many_shingles_as_they_must():
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    for n, least in [(n, least) for n in (1, 2, 511, 512, 513, 640, 1500, 5000) for least in (0.02, 0.5, 0.8, 1.0)] * 4:
        gone = rng.integers(0, n - math.ceil(least * n) + 1)
        most = math.floor((n - gone) / least + 1e-9) - n  # so many more, and the likeness is the least or just over
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        b = np.union1d(a[rng.permutation(len(a))[gone:]], rng.integers(-(2**62), 2**62, int(rng.integers(0, max(0, min(most, 4 * n)) + 1))))
        both = len(np.intersect1d(a, b))
        if both < least * (len(a) + len(b) - both) - 1e-9:
            continue
        pre = [jaccard.prefix(s, least, None) for s in (a, b)]
        need = min(int(jaccard.shared(np.asarray(len(s)), least)) for s in (a, b))
        assert len(np.intersect1d(*pre)) >= need >= 1
        assert need == 1 or min(len(a), len(b)) >= jaccard.LONG
