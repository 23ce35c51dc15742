import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import toxicity as tox

WORDS = "the cat sat near river stone green while people walk along winter morning light table paper".split()
BAD = ["grumbo", "snarkel", "fozzle"]


def labelled(seed, n, disguise=None):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 40))]
        y = int(rng.random() < 0.3)
        for _ in range(3 * y):
            w = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), disguise(w, rng) if disguise else w)
        rows.append((k, " ".join(words)))
        labels.append((k, y))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = labelled(1, 400)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return tox.learn(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def test_char_counts_equal_brute_force():
    want = Counter()
    for word in "ab caté ab".split():
        folded = "".join(tox.FOLD.get(ord(c), c) for c in word)
        codes = [0, 0, 0, *(ord(c) - 96 for c in folded), 0]
        for k in range(3, len(codes)):
            want[((codes[k - 3] * 27 + codes[k - 2]) * 27 + codes[k - 1]) * 27 + codes[k]] += 1
    got = tox.char_counts("AB caté, ab")
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    lm = np.log(rng.dirichlet(np.ones(27), 27**3)).ravel().tolist()
    for token in ["a1b", "aa$b", "o00h", "a*c!", "x-y", "1111", "a b", "ab c d"]:
        best = None
        for path in itertools.product(*tox.lattice(token)):
            ctx, cost = 0, 0.0
            for sign, extra in path:
                cost += extra
                if sign == tox.BORDER:
                    cost -= lm[ctx * 27] if ctx else 0
                    ctx = 0
                elif sign > 0:
                    cost -= lm[ctx * 27 + sign]
                    ctx = ctx % 729 * 27 + sign
                elif sign < 0 and ctx % 27 != -sign:
                    cost = np.inf
            cost -= lm[ctx * 27]
            if best is None or cost < best[0]:
                best = (cost, " ".join("".join(" " if s == tox.BORDER else chr(96 + s) for s, _ in path if s > 0).split()))
        assert " ".join(tox.viterbi(token, lm).split()) == best[1]


DISGUISES = {
    "leet": lambda w, rng: w.translate(str.maketrans("oeaszl", "034521")),
    "spaced": lambda w, rng: " ".join(w),
    "broken": lambda w, rng: w[: (k := rng.randint(2, len(w) - 2))] + " " + w[k:],
    "in threes": lambda w, rng: " ".join(w[k : k + 3] for k in range(0, len(w), 3)),
    "joined to an article": lambda w, rng: "a " + " ".join(w),
    "dotted": lambda w, rng: ".".join(w),
    "repeated": lambda w, rng: w[0] + w[1] * rng.randint(3, 6) + w[2:],
    "shouted": lambda w, rng: w.upper() + "!!!",
}


@pytest.mark.parametrize("kind", DISGUISES)
def test_held_out_disguises(model, docs, kind):
    rows, labels = labelled(7, 120, DISGUISES[kind])
    got = {r.doc_id: r.score >= 0.3 for r in tox.score(docs(rows), model).collect()}
    assert sum(got[k] == bool(y) for k, y in labels) >= 116


def test_words_set_apart_keep_their_borders(model):
    lm = model.lm.astype(float).tolist()
    assert tox.restore_run("a s t o n e n e a r", lm) == ["a", "stone", "near"]
    assert "fozzle" in tox.restore_run("the f o z z l e", lm)


def test_signs_alone_and_numbers(model):
    lm = model.lm.astype(float).tolist()
    assert tox.restore("@$$", lm) and tox.restore("4$$", lm)
    assert not any(tox.restore(t, lm) for t in ("455", "$100", "12:30", "50%", "2019-05-01", "!", "..."))


def test_telling_needs_a_ratio_whatever_the_size():
    assert tox.is_telling(0, 20, 1000, 1000) and not tox.is_telling(0, 10, 1000, 1000) and tox.is_telling(0, 6, 1000, 100) and not tox.is_telling(0, 5, 1000, 10)
    assert not tox.is_telling(50_000, 60_000, 10**6, 10**6)
    assert tox.is_telling(50_000, 150_000, 10**6, 10**6)


def test_sample_is_weighted_back(docs, spark):
    rows, labels = labelled(11, 600)
    df = docs(rows)
    some = tox.learn(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"), fit_rows=240)
    score = {r.doc_id: r.score for r in tox.score(df, some).collect()}
    assert abs(sum(score.values()) - sum(y for _, y in labels)) < 60


def test_edges(model, docs):
    rows = [(1, None), (2, ""), (3, "fozzle" * 20000), (4, "grumbo"), (4, "grumbo"), (5, "日本語 123")]
    got = tox.score(docs(rows), model, with_text=True).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.restored for r in got}[4] == "grumbo"
    assert tox.score(docs([]), model).count() == 0


def test_copies_of_a_document_teach_no_words(docs, spark):
    rows, labels = labelled(3, 300)
    extra = [(1000 + k, "unusual phrase of copied page") for k in range(30)]
    df = spark.createDataFrame([*rows, *extra], "doc_id bigint, text string")
    y = spark.createDataFrame([*labels, *((d, 1) for d, _ in extra)], "doc_id bigint, toxic int")
    assert not {"unusual", "phrase", "copied"} & set(tox.learn(df, y).words)


def test_one_label_only(docs, spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    y = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert [r.score for r in tox.score(df, tox.learn(df, y)).collect()] == [0.0]
