import random
import re

from pyspark.sql import functions as F

from tagweave.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def run(df):
    return licenses.digest(licenses.scan(df, licenses.build_index(df))).collect()


def test_base_columns_equal_brute_force(docs):
    rng = random.Random(4)
    bits = "CC by all Rights reserved general public license GNU the é\xa0x 4.0 cc-by, under ALL\x00rights İ".split(" ")
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "cc by " * 20000, "All rights reserved. All Rights\nReserved"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = run(docs(rows).withColumn("places", F.lit(1)).withColumn("n_words", F.lit(1)))
    assert len(got) == len(rows)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id]) for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_notices(docs):
    texts = {
        1: "x. This work is licensed under the GNU General Public License, version 3.", 2: "Licensed under CC BY-NC 4.0.", 3: "Released under the MIT License.",
        4: "Licensed under the Apache License, Version 2.0.", 5: "license the under released mit", 6: "Released under a MIT License", 7: "apache version license 2 0 licensed under the",
    }
    got = {r.doc_id: (r.labels, r.score) for r in run(docs(list(texts.items())))}
    assert {k: v[0] for k, v in got.items()} == {1: "gpl,gpl-3.0", 2: "cc-by,cc-by-nc-4.0", 3: "mit", 4: "apache-2.0", 5: "", 6: "mit", 7: ""}
    assert got[3][1] == 1.0 and 0.8 <= got[6][1] < 1 and got[5][1] == 0.0


def plain_places(words, notices):
    """Every place where enough of a notice stands with its key, by trying all places."""
    found = []
    for k, n in enumerate(notices):
        own, key = WORD.findall(n.text), WORD.findall(n.key)
        at = next(q for q in range(len(own)) if own[q : q + len(key)] == key)
        for shift in range(1 - len(own), len(words)):
            same = [0 <= shift + q < len(words) and words[shift + q] == w for q, w in enumerate(own)]
            if all(same) or not n.whole and sum(same) >= licenses.COVERED * len(own) and all(same[at : at + len(key)]):
                found.append((k, max(shift, 0), sum(same) / len(own)))
    return found


def test_places_equal_trying_all_places(docs):
    rng = random.Random(6)
    notices = licenses.PHRASES + licenses.NOTICES
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = WORD.findall(rng.choice(notices).text)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(["other", "the", "license"])
            words += [rng.choice(["a", "the", "of", "software"]) for _ in range(rng.randint(0, 9))] + own
        texts.append(" ".join(words))
    df = docs(list(enumerate(texts)))
    index = licenses.build_index(df, anchors=99)  # every word an anchor: half of them vote wherever enough stands
    for t in texts:
        got = index.scan(licenses.words_of(t))
        assert sorted(got) == sorted(plain_places(WORD.findall(t), notices)), t
    few = licenses.build_index(df)  # rare words alone lose no place that is whole
    for t in texts:
        whole = [p for p in plain_places(WORD.findall(t), notices) if p[2] == 1.0]
        assert set(whole) <= set(few.scan(licenses.words_of(t)))


def test_labels_of_every_notice(docs):
    got = {r.doc_id: r.labels.split(",") for r in run(docs([(k, n.text) for k, n in enumerate(licenses.NOTICES)]))}
    assert all(n.label in got[k] for k, n in enumerate(licenses.NOTICES))


def test_empty(docs):
    assert run(docs([])) == []
