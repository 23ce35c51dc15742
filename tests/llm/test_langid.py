import math
import random
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from tagweave.llm import langid

SYL = {"xa": ["ka", "lo", "mi", "tu"], "xb": ["ber", "gen", "sch", "wur"], "xc": ["ñas", "ció", "ro", "dad"]}


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYL))
        words = ["".join(rng.choice(SYL[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))]
        out.append((k, " ".join(words), lang, "src0", 0))
    return out


def plain_model(rows, word_share, gram_share, longest):
    counts = {}
    for _, text, lang, *_ in rows:
        if text and lang:
            for w in langid.words_of(text):
                counts.setdefault((lang, 0), Counter())[w] += 1
                for n in range(1, longest + 1):
                    counts.setdefault((lang, n), Counter()).update(langid.grams_of(w, n))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    return counts, totals


def test_learned_counts_and_scores_equal_brute_force(docs):
    rows = corpus(1, 150)
    model = langid.learn(docs(rows), 0.002, 0.001, 3)
    counts, totals = plain_model(rows, 0.002, 0.001, 3)
    for size in range(4):
        share = 0.001 if size else 0.002
        items = {w for (a, s), c in counts.items() if s == size for w, n in c.items() if n >= share * totals[a, s]}
        assert len(model.tables[size][0]) == len(items)
        for w in items:
            (row,) = model.rows(size, [w])
            for k, a in enumerate(model.langs):
                want = math.log((counts[a, size][w] + 0.5) / (totals[a, size] + 0.5 * (len(items) + 1)))
                assert abs(row[k] - want) < 1e-9


def test_backoff_order():
    counts = {(0, "one"): {"a": 9}, (2, "^t"): {"b": 5}, (1, "z"): {"a": 4}}
    model = langid.Model.of_counts(["a", "b"], counts, {("a", 0): 9, ("b", 2): 5, ("a", 1): 4})
    assert (model.score("one") == model.rows(0, ["one"])[0]).all()
    assert (model.score("two") == model.rows(2, ["^t"])[0]).all()
    assert (model.score("zz") == model.rows(1, ["z"])[0]).all()
    assert not model.score("q").any()


def plain_prediction(text, counts, totals, langs, share, longest):
    """Of one text, from counts alone."""
    known = {s: {w for (a, z), c in counts.items() if z == s for w, n in c.items() if n >= share * totals[a, s]} for s in range(longest + 1)}
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    if not words:
        return "und"

    def log_of(a, s, item):
        return math.log((counts[a, s][item] + 0.5) / (totals[a, s] + 0.5 * (len(known[s]) + 1)))

    scores = dict.fromkeys(langs, 0.0)
    for w in words:
        if w in known[0]:
            found, s = [w], 0
        else:
            s, found = next(((s, g) for s in range(longest, 0, -1) if (g := [x for x in langid.grams_of(w, s) if x in known[s]])), (0, []))
        for a in langs:
            scores[a] += sum(log_of(a, s, x) for x in found) / max(1, len(found))
    return max(langs, key=lambda a: (scores[a], -langs.index(a)))


def test_predictions_equal_brute_force(docs):
    rows = corpus(5, 60)
    counts, totals = plain_model(rows, 0, 0, 3)
    model = langid.learn(docs(rows), 0.01, 0.01, 3)
    texts = [t for _, t, *_ in corpus(6, 40)] + ["½ ² Ⅷ", "kalo²wurgen x", "ÑAS ció", "qqq"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(list(enumerate(texts))), model).collect()}
    assert got == {k: plain_prediction(t, counts, totals, model.langs, 0.01, 3) for k, t in enumerate(texts)}


def test_no_letters_are_undetermined(docs):
    model = langid.learn(docs(corpus(1, 30)))
    texts = ["½", "²", "①", "Ⅷ", "٣", "१", "_", "12", "Ⓐ", "", None, "\u0301"]
    assert {r.lang_pred for r in langid.predict(docs(list(enumerate(texts))), model).collect()} == {"und"}
    assert [r.lang_pred != "und" for r in langid.predict(docs([(1, "ª")]), model).collect()] == [True]


def test_accuracy_on_held_out_texts(docs):
    model = langid.learn(docs(corpus(1, 200)))
    test = corpus(2, 100)
    got = {r.doc_id: r for r in langid.predict(docs(test), model).collect()}
    assert sum(got[d].lang_pred == lang for d, _, lang, *_ in test) >= 98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nulls_empty_and_clashing_columns(docs):
    model = langid.learn(docs([*corpus(1, 30), (99, None, "xa", None, None), (98, "x y", None, None, None)]))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "kalo " * 30000), (4, "kalo")]
    df = docs(rows).withColumn("score", F.lit("x")).withColumn("item", F.lit(2))
    got = sorted((r.doc_id, r.lang_pred, r.score > 0, r.item) for r in langid.predict(df, model).collect())
    assert got == [(1, "und", False, 2), (2, "und", False, 2), (3, "und", False, 2), (4, "xa", True, 2), (4, "xa", True, 2)]


def test_nothing_learned(docs):
    model = langid.learn(docs([]))
    assert [r.lang_pred for r in langid.predict(docs([(1, "abc")]), model).collect()] == ["und"]
    assert langid.predict(docs([]), model).count() == 0


def test_words_known_in_one_language_keep_their_counts_in_the_others(docs):
    rows = [(1, "shared " * 51 + "fra " * 949, "fr", "s", 0), (2, "shared " * 49 + "esp " * 951, "es", "s", 0), (3, None, "fr", "s", 0)]
    model = langid.learn(docs(rows), word_share=0.05)
    es, fr = model.score("shared").tolist()
    assert abs((fr - es) - math.log(51.5 / 49.5)) < 1e-9


def test_a_worker_lets_go_of_the_tokenizer_tables():
    import public_tokenizers
    import pyarrow as pa

    from tagweave.llm import jaccard, tokens

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "lang": ["en", "de"], "text": ["one two one", "zwei"]})
    for run in (langid._CountWords(), jaccard._Items(2)):
        tokens.encoder(path).raw("a table that a task before has left")
        assert sum(b.num_rows for b in run(iter([batch]))) == 3
        assert tokens.encoder.cache_info().currsize == 0
