import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tagweave.llm import mixing


def test_split_budget():
    assert mixing.split_budget(10, [100, 100], [1, 3]) == [2.5, 7.5]
    assert mixing.split_budget(10, [1, 100, 100], [2, 1, 1]) == [1, 4.5, 4.5]
    assert mixing.split_budget(10, [1, 2], [1, 1]) == [1, 2]
    assert mixing.split_budget(6, [5, 5], [0, 0]) == [3, 3]


def test_shortage_goes_to_siblings_before_ancestors():
    tokens = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100}
    assert mixing.leaf_budgets(tokens, [{}, {}], 100, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}
    tokens[("a", "y")] = 20
    assert mixing.leaf_budgets(tokens, [{}, {}], 100, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 70}
    assert mixing.leaf_budgets({}, [{}, {}], 100, 1) == {}


def plain_budgets(tokens, weights, budget, epochs):
    """Water filling with exact fractions, one level after the other, then whole tokens by largest fractions."""
    out = {}

    def fill(budget, capacity, weight):
        got, open_ = dict.fromkeys(capacity, Fraction(0)), {k for k, c in capacity.items() if c}
        budget = min(budget, sum(capacity.values()))
        while open_ and budget > sum(got.values()):
            left, total = budget - sum(got.values()), sum(weight[k] for k in open_)
            # up to where the first is full
            part = {k: Fraction(weight[k]) / total if total else Fraction(1, len(open_)) for k in open_}
            step = min([left] + [(capacity[k] - got[k]) / part[k] for k in open_ if part[k]])
            for k in open_:
                got[k] += step * part[k]
            open_ = {k for k in open_ if got[k] < capacity[k]}
        return got

    def go(prefix, budget):
        level = len(prefix)
        below = [p for p in tokens if p[:level] == prefix]
        if level == len(weights):
            out[prefix] = budget
            return
        names = {p[level] for p in below}
        capacity = {n: Fraction(epochs * sum(tokens[p] for p in below if p[level] == n)) for n in names}
        for n, b in fill(budget, capacity, {n: Fraction(str(weights[level].get(n, 1))) for n in names}).items():
            go((*prefix, n), b)

    go((), Fraction(budget))
    whole = {p: int(b) for p, b in out.items()}
    left = min(budget, epochs * sum(tokens.values())) - sum(whole.values())
    for p in sorted(out, key=lambda p: (whole[p] - out[p], p))[:left]:
        whole[p] += 1
    return whole


def test_budgets_equal_exact_fractions():
    rng = random.Random(2)
    for _ in range(60):
        tokens = {(f"domain{a}", lang, f"src{s}"): rng.choice([0, 3, 50, 1000]) for a in range(3) for lang in ("en", "de") for s in range(rng.randint(1, 3))}
        budget, epochs = rng.randint(1, 4000), rng.randint(1, 3)
        got = mixing.leaf_budgets(tokens, mixing.WEIGHTS, budget, epochs)
        want = plain_budgets(tokens, mixing.WEIGHTS, budget, epochs)
        assert sum(got.values()) == sum(want.values()) == min(budget, epochs * sum(tokens.values()))
        assert max(abs(got[p] - want[p]) for p in tokens) <= 1


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "en", "en", "de", None]), rng.choice(["src0"] * 5 + [f"src{i}" for i in range(6)] + [None]), 0) for k in range(n)]


@pytest.mark.parametrize(("budget", "epochs"), [(0.5, 1), (0.9, 2), (1.5e4, 3)])
def test_equals_brute_force(spark, docs, budget, epochs):
    rows = rows_of(1, 600)
    df = docs(rows)
    got = mixing.mix(df, mixing.default_levels(), mixing.WEIGHTS, budget, max_epochs=epochs, seed=5).collect()
    key = {(r.doc_id, e): r[f"h{e}"] for r in df.select("doc_id", *(mixing.order_key(5, F.lit(e)).alias(f"h{e}") for e in range(4))).collect() for e in range(4)}
    leaf_of = {d: (f"domain{int((s or 'src0')[3:]) % 4}", a or "", s or "") for d, _, a, s, _ in rows}
    size = {d: len(t.split()) for d, t, *_ in rows}
    held = Counter()
    for d, p in leaf_of.items():
        held[p] += size[d]
    total = sum(held.values())
    budgets = plain_budgets({p: n for p, n in held.items() if n}, mixing.WEIGHTS, int(budget if budget >= 1 else budget * total), epochs)
    want = set()
    for leaf, b in budgets.items():
        own = [d for d in leaf_of if leaf_of[d] == leaf and size[d]]
        e = 0
        while b > 0:
            for d in sorted(own, key=lambda d: (key[d, e], d)):
                take = min(size[d], b)
                if take:
                    want.add((d, e, take))
                b -= take
            e += 1
    assert {(r.doc_id, r.epoch, r["take"]) for r in got} == want and len(got) == len(want)


def test_edges(docs):
    df = docs([(None, "a b", None, None, None), (1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (3, "x " * 50000, "en", "src1", 0), (3, "x y", "en", "src1", 0)])
    got = mixing.mix(df.withColumn("take", F.lit("z")).withColumn("rest", F.lit(0)), mixing.default_levels(), mixing.WEIGHTS, 0.5, max_epochs=1).collect()
    assert all(r["take"] > 0 for r in got) and {r.doc_id for r in got} <= {None, 3}
    assert mixing.mix(docs([]), mixing.default_levels(), mixing.WEIGHTS).count() == 0
