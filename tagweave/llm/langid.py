"""Language identification by word-first backoff (operator 7).

A word that is known scores by its log frequency in each language; a word that is not falls back to
its character n-grams, the longest length of which any is known, down to single letters.

The known words and n-grams are those that make up at least ``WORD_SHARE`` or ``GRAM_SHARE`` of the
running words or n-grams of that length in any one language; each is known with its true counts in all
languages. There are so at most one over the share of them for each language, whatever the size of the
corpus, which bounds the model that is broadcast; rarer words go by their n-grams (what that costs in
accuracy is in the README). Counts are taken over all documents given. The model holds 64-bit hashes of
the items and the languages that have each, about 20 bytes for an item of one language.

Defined results: a text that is null, empty or without a letter gets ``und`` and score 0, and so
does every text if nothing was learned; null languages and texts teach nothing; ties go to the language
first in order; repeated rows repeat; other columns are carried through unless a name clashes with
``lang_pred`` or ``score``, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import common

WORD_SHARE, GRAM_SHARE, LONGEST = 1e-6, 5e-6, 5
WORDS = re.compile(r"[^\W\d_]+")
HELD, KNOWN = 200_000, 1_200_000  # items counted at once; scores remembered at once
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; other numeric characters (½, ², Ⅷ) part words as digits do."""
    low = text.lower()
    found = WORDS.findall(low)
    return found if "".join(found).isalpha() or not found else "".join(c if c.isalpha() else " " for c in low).split()


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between its marked ends; single letters go without the marks."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class _CountWords:
    SCHEMA = pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())])

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush():
            while counts:
                lang, c = counts.popitem()
                yield common.table({"lang": [lang] * len(c), "item": list(c), "n": list(c.values())}, self.SCHEMA)

        for batch in common.slices(batches, 256):
            for lang, text in zip(batch.column("lang").to_pylist(), common.texts(batch), strict=True):
                counts[lang].update(words_of(text))
            if sum(map(len, counts.values())) > HELD:
                yield from flush()
        yield from flush()


class _CountGrams:
    SCHEMA = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("item", pa.string()), ("n", pa.int64())])

    def __init__(self, longest: int):
        self.longest = longest

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], dict[str, int]] = defaultdict(lambda: defaultdict(int))

        def flush():
            while counts:
                (lang, size), c = counts.popitem()
                yield common.table({"lang": [lang] * len(c), "size": [size] * len(c), "item": list(c), "n": list(c.values())}, self.SCHEMA)

        for batch in common.slices(batches, 512):
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n")), strict=True):
                for size in range(1, self.longest + 1):
                    own = counts[lang, size]
                    for g in grams_of(word, size):
                        own[g] += n
            if sum(map(len, counts.values())) > HELD:
                yield from flush()
        yield from flush()


def hash_of(item: str) -> int:
    """What Spark's ``xxhash64`` gives for a string."""
    return xxhash.xxh64_intdigest(item.encode("utf-8", "surrogatepass"), 42)


class Model:
    """Log frequencies of known words (size 0) and n-grams by language, kept sparsely: for every size the
    sorted hashes of the items and, from ``starts``, the languages that have them with their log frequency."""

    def __init__(self, langs: list[str], totals: dict[tuple[str, int], int], sizes: np.ndarray, hashes: np.ndarray, starts: np.ndarray, at: np.ndarray, n: np.ndarray):
        """Item k of ``sizes`` and ``hashes`` has the languages ``at[starts[k]:starts[k + 1]]`` with counts ``n``."""
        self.langs, self.tables, self.none = langs, [], []
        many = np.diff(starts)
        for size in range(int(max([0, *(s for _, s in totals)])) + 1 if langs else 0):
            own = np.flatnonzero(sizes == size)
            own = own[np.argsort(hashes[own])]
            total = np.log(np.asarray([totals.get((lang, size), 0) for lang in langs], float) + 0.5 * (len(own) + 1))
            begin = np.r_[0, np.cumsum(many[own])]
            flat = np.repeat(starts[own] - begin[:-1], many[own]) + np.arange(begin[-1])
            self.none.append(np.log(0.5) - total)
            self.tables.append((hashes[own], begin.astype(np.int64), at[flat].astype(np.int32), np.log(n[flat] + 0.5) - total[at[flat]]))

    @classmethod
    def of_counts(cls, langs: list[str], counts: dict[tuple[int, str], dict[str, int]], totals: dict[tuple[str, int], int]) -> Model:
        """counts: (size, item) -> language -> n."""
        rows = [(s, hash_of(i), [(langs.index(a), n) for a, n in c.items()]) for (s, i), c in counts.items()]
        pairs = [p for _, _, c in rows for p in c]
        starts = np.r_[0, np.cumsum([len(c) for _, _, c in rows], dtype=np.int64)]
        return cls(langs, totals, np.asarray([s for s, _, _ in rows], np.int64), np.asarray([h for _, h, _ in rows], np.uint64), starts, np.asarray([a for a, _ in pairs], np.int64), np.asarray([n for _, n in pairs], np.int64))

    def _find(self, size: int, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which of the items are known, rows of log frequencies by language of those)."""
        hashes, begin, at, value = self.tables[size]
        wanted = np.fromiter(map(hash_of, items), np.uint64, len(items))
        place = np.searchsorted(hashes, wanted)
        known = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == wanted) if len(hashes) else np.zeros(0, np.int64)
        low, many = begin[place[known]], begin[place[known] + 1] - begin[place[known]]
        flat = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        rows = np.tile(self.none[size], (len(known), 1))
        rows[np.repeat(np.arange(len(known)), many), at[flat]] = value[flat]
        return known, rows

    def rows(self, size: int, items: list[str]) -> np.ndarray:
        """Log frequencies by language of those of the items that are known."""
        return self._find(size, items)[1]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log frequencies, or the mean of those of its longest known n-grams, or zeros."""
        out = np.zeros((len(words), len(self.langs)))
        if not self.tables or not words:
            return out
        known, rows = self._find(0, words)
        out[known] = rows
        left = np.delete(np.arange(len(words)), known)
        for size in range(len(self.tables) - 1, 0, -1):
            grams = [grams_of(words[k], size) for k in left.tolist()]
            owner = np.repeat(np.arange(len(left)), list(map(len, grams)))
            known, rows = self._find(size, [g for own in grams for g in own])
            count = np.bincount(owner[known], minlength=len(left))
            for lang in range(len(self.langs)):
                total = np.bincount(owner[known], rows[:, lang], len(left))
                out[left[count > 0], lang] = total[count > 0] / count[count > 0]
            left = left[count == 0]
        return out

    def score(self, word: str) -> np.ndarray:
        return self.scores([word])[0]


class _Rows(dict):
    """Word -> row of ``scores``; made anew between batches when it is large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.scores = model, np.zeros((1024, len(model.langs)))

    def add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        start, end = len(self), len(self) + len(new)
        while end > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[start:end] = self.model.scores(new)
        self.update(zip(new, range(start, end), strict=True))


class _Predict:
    def __init__(self, model, schema: pa.Schema):
        self.model, self.schema = model, schema

    @common.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = self.model.value
        rows = _Rows(model)
        for batch in common.slices(batches, 256):
            if len(rows) * len(model.langs) > KNOWN:
                rows = _Rows(model)
            pred, score = predict_texts(common.texts(batch), model, rows)
            kept = [batch.column(f.name) for f in self.schema if f.name not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=self.schema)


def predict_texts(texts: list[str], model: Model, rows: _Rows | None = None) -> tuple[list[str], list[float]]:
    """(language, score) of each text. The score is the posterior of the language when the mean
    evidence of a word is counted for up to twenty words."""
    rows = _Rows(model) if rows is None else rows
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return pred, score
    split = [words_of(t) for t in texts]
    own = [k for k, w in enumerate(split) if w]
    if own:
        rows.add({w for k in own for w in split[k]})
        at = np.asarray([rows[w] for k in own for w in split[k]])
        sizes = np.asarray([len(split[k]) for k in own])
        sums = np.add.reduceat(rows.scores[at], np.cumsum(sizes) - sizes)
        mean = sums / sizes[:, None] * np.minimum(sizes, 20)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k, best, v in zip(own, sums.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            pred[k], score[k] = model.langs[best], v
    return pred, score


def learn(docs: DataFrame, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE, longest: int = LONGEST) -> Model:
    """Learn from ``text`` and ``lang`` of all rows. Collected: totals, and the known words and n-grams as hashes."""
    spark = docs.sparkSession
    train = docs.where("lang is not null and text is not null").select("lang", "text")
    words = train.mapInArrow(_CountWords(), "lang string, item string, n bigint").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    with common.few_texts(spark):
        words = common.materialise(words, "words")
    grams = words.mapInArrow(_CountGrams(longest), "lang string, size int, item string, n bigint").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    grams = common.materialise(grams, "grams")
    both = words.select("lang", F.lit(0).alias("size"), "item", "n").unionByName(grams)
    totals = {(r.lang, r["size"]): r.n for r in both.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({a for a, _ in totals})
    limits = [(a, s, langs.index(a), float(n * (gram_share if s else word_share))) for (a, s), n in totals.items()]
    limits = spark.createDataFrame(limits, "lang string, size int, at int, least double")  # a row for each language and length
    known = both.join(F.broadcast(limits), ["lang", "size"]).groupBy("size", "item").agg(F.collect_list(F.struct("at", "n")).alias("found"), F.max(F.col("n") >= F.col("least")).alias("known"))
    table = known.where("known").select("size", F.xxhash64("item").alias("hash"), "found").toArrow()
    if not table.num_rows:
        return Model.of_counts([], {}, {})
    size, hashes, found = (pa.concat_arrays(table.column(c).chunks) for c in ("size", "hash", "found"))
    pairs = found.flatten()
    starts = np.asarray(found.offsets.to_numpy(), np.int64)
    return Model(langs, totals, size.to_numpy(), hashes.to_numpy().view(np.uint64), starts - starts[0], pairs.field("at").to_numpy(), pairs.field("n").to_numpy())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("lang_pred", "score")
    out = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.mapInArrow(_Predict(docs.sparkSession.sparkContext.broadcast(model), to_arrow_schema(out.schema)), out.schema)
