import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import hilbert


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_keys_walk_through_all_cells_by_unit_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute(rows, k):
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in sound:
        if i % 10 == 0:
            out[i] = sorted((math.dist(v, w), j) for j, w in sound if j != i)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4).withColumn("vec", F.lit(1)).withColumn("block", F.lit("x"))


def test_recall_and_order(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(16)]) for k in range(2500)]
    got = hilbert.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    want = brute(rows, 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    assert set(found) == set(want)
    dist = dict(rows)
    hits = 0
    for q, by_rank in found.items():
        listed = [by_rank[k] for k in range(1, len(by_rank) + 1)]
        assert listed == sorted(listed) and all(abs(s - math.dist(dist[q], dist[v])) < 1e-9 for s, v in listed)
        hits += len({v for _, v in listed} & {v for _, v in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_common_vector_ties_and_unsound_rows(spark):
    rows = [(k, [1.0, 2.0]) for k in range(300)] + [(1000, [5.0, 5.0]), (1001, None), (1010, [0.0, 0.0]), (1020, [float("nan"), 1.0]), (1030, [None, 1.0]), (1040, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    got = hilbert.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r.query_id, []).append(r.vec_id)
    assert set(lists) == {*range(0, 300, 10), 1000}
    assert lists[0] == list(range(1, 11)) and lists[290] == list(range(10)) and lists[1000] == list(range(10))


def test_few_and_none(spark):
    got = hilbert.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), F.col("vec_id") % 10 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)]
    assert hilbert.nearest(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
