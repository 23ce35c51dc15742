"""Toxicity scores after noisy-channel deobfuscation (operator 1).

A word that may be disguised becomes a lattice: a letter stands for itself, leetspeak signs for the
letters they imitate, signs between letters may be noise, and a repeated letter may have been typed
once. A run of short fragments is one lattice, in which a blank is noise or the border of two words.
Viterbi search finds the likeliest reading under a character language model of order four that is
counted over all documents. A token that is written as a number is read as one. Word weights are learned
from labelled documents and applied to the restored words.

Words count in squeezed form, repeated letters written once, so that a word typed with more letters is
the same word, and so do the stems that they go on from, for inflected words.

Learning has these steps: character 4-grams of all texts; a sample of the labelled rows, about half of
``FIT_ROWS`` for each label at most, drawn by a hash of the id where there are more (this bound alone
limits the classifier, and it bounds what is broadcast and collected); in it, document counts of the words
of toxic texts and of those in ``LEAST`` of them the counts in other texts. A word is telling if the lower
confidence bound of the ratio of its two rates is over ``RATIO``, by documents and also when each pair
of neighbours counts once, which copies of a document don't multiply. A logistic regression on all
telling words follows, its rows weighted back to the share of their label. The character model then learns the telling words anew,
since they are what is disguised.

Defined results: null text counts as empty; a text without telling words, empty ones too, gets the base
score; labels that are null or not 0 or 1 teach nothing, labels of absent documents neither; without both
labels, and for an empty table of documents to learn from, every score is 0; repeated rows
repeat, and repeated labels count again; other columns are ignored; a token or run of any length is
decoded whole in time linear in its length.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import common

A = 27  # word end and the letters a-z
FIT_ROWS = 40_000
STEMS = (4, 8)  # lengths of the stems that are counted beside words
#: A telling word is in so many toxic documents at least, and has this ratio of rates, so many standard errors below the one found.
LEAST, RATIO, ERRORS = 6, 2.0, 2.0
HELD, KNOWN = 200_000, 400_000

# Signs of leetspeak and the letters that they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
WILD = "*"  # stands for any vowel
LEET_COST, LOST_SIGN, LOST_DIGIT, EDGE_SIGN, LEADING, NOISE, WILD_COST = 1.0, 6.0, 8.0, 0.4, 3.0, 0.5, 2.0
#: A repeated letter of a run of two, of a longer run: read as typed once more, or dropped.
TWICE_KEPT, TWICE_LOST, LONG_KEPT, LONG_LOST = 0.0, 5.0, 3.0, 0.3

#: Cost of a blank as noise, between single signs and between other fragments; a word border costs nothing of its own.
SPACED, BROKEN = 0.5, 4.0
BORDER = 100

# a run: fragments of up to four signs that aren't numbers of two digits or more
_FRAGMENT = r"(?![0-9]{2,}(?!\S))\S{1,4}"
_RUN = re.compile(rf"(?<!\S){_FRAGMENT}(?:[^\S\n]+{_FRAGMENT})+(?!\S)")
_SPACED = re.compile(r"(?<!\S)(?:\S[^\S\n]+){2,}\S(?!\S)")
_NUMBER = re.compile(r"[$€£+(#~-]?[0-9]+(?:[.,:/-][0-9]+)*[)+%!]?")
_LETTERS = re.compile(r"[^a-z\n]+")
_PARTS = re.compile(r"[a-z0-9@$!|+(€£¡¢*]+")


def _folds() -> dict[int, str]:
    """Accented Latin letters without their marks."""
    out = {ord("ß"): "s", ord("ø"): "o", ord("æ"): "ae", ord("œ"): "oe", ord("ł"): "l", ord("đ"): "d"}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if "a" <= base <= "z":
            out.setdefault(c, base)
    return out


FOLD = _folds()
_CODES = np.zeros(256, np.int64)
for _c in range(256):
    _f = FOLD.get(_c, chr(_c))[0]
    if "a" <= _f <= "z":
        _CODES[_c] = ord(_f) - 96


def char_counts(text: str) -> np.ndarray:
    """Counts of (three symbols before, symbol), what lies before a word counting as empty."""
    c = _CODES[np.frombuffer(b"   " + text.lower().encode("latin-1", "replace") + b" ", np.uint8)]
    a1, a2, a3, now = c[2:-1], c[1:-2], c[:-3], c[3:]
    in1 = a1 > 0
    in2 = in1 & (a2 > 0)
    at = ((a3 * in2 * A + a2 * in1) * A + a1) * A + now
    return np.bincount(at[in1 | (now > 0)], minlength=A**4)


class _CharCounts:
    SCHEMA = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(A**4, np.int64)
        for batch in common.slices(batches):
            held, size = [], 0
            for text in [*common.texts(batch), None]:
                if text is None or size > 1 << 21:
                    counts += char_counts("\n".join(held))
                    held, size = [], 0
                if text:
                    held.append(text)
                    size += len(text)
        used = np.flatnonzero(counts)
        yield common.table({"gram": used, "n": counts[used]}, self.SCHEMA)


def language_model(counts: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """Log probabilities of a symbol after three, each order smoothed by the next lower one."""
    by_order = [counts.reshape(-1, A)]
    for n in (2, 1, 0):
        by_order.append(by_order[-1].reshape(A, -1, A).sum(0) if n else by_order[-1].sum(0, keepdims=True))
    p = np.full((1, A), 1 / A)
    for c in reversed(by_order):
        lower = np.tile(p, (len(c) // len(p), 1))
        p = (c + strength * lower) / (c.sum(1, keepdims=True) + strength)
    return np.log(p).ravel()


def lattice(token: str) -> list[list[tuple[int, float]]]:
    """Readings of each sign of a folded lower-case token or of a run with single blanks: (letter 1-26, 0 for
    none, -letter for none where that letter stands before or ``BORDER`` for the end of a word, cost)."""
    out = []
    solid = [k for k, c in enumerate(token) if c.isascii() and c.isalnum()]
    first, last = (solid[0], solid[-1]) if solid else (0, -1)
    run = 0
    for k, c in enumerate(token):
        run = run + 1 if k and token[k - 1] == c else 1
        after = 1 if token[k + 1 : k + 2] == c else 0
        if "a" <= c <= "z":
            letter = ord(c) - 96
            long = run > 2 or (run == 2 and after)
            out.append([(letter, 0.0)] if run == 1 else [(letter, LONG_KEPT if long else TWICE_KEPT), (-letter, LONG_LOST if long else TWICE_LOST)])
        elif c in LEET:
            single, inside = run == 1 and not after, first <= k <= last
            edge = EDGE_SIGN if not single or c == "!" and k > last else LEADING
            lost = LOST_DIGIT if c.isdigit() else LOST_SIGN if inside and single else edge
            readings = [(ord(x) - 96, LEET_COST) for x in LEET[c]]
            again = [(-r, LONG_LOST) for r, _ in readings] if run > 1 else []
            out.append([*readings, *again, (0, lost)])
        elif c == WILD:
            single = run == 1 and not after
            out.append([*([(ord(x) - 96, WILD_COST) for x in "aeiou"] if single else []), (0, LEADING if single else NOISE)])
        elif c == " ":
            lone = (k < 2 or token[k - 2] == " ") and (k + 2 >= len(token) or token[k + 2] == " ")
            out.append([(0, SPACED if lone else BROKEN), (BORDER, 0.0)])
        else:
            out.append([(0, NOISE)])
    return out


def viterbi(token: str, lm: list[float]) -> str:
    """The likeliest word behind a token, of letters a-z; the likeliest words behind a run."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in lattice(token):
        new: dict[int, tuple[float, tuple | None]] = {}
        for ctx, (cost, node) in states.items():
            for sign, extra in options:
                if sign == BORDER:
                    to, total, made = 0, cost + extra - (lm[ctx * A] if ctx else 0.0), (node, BORDER) if ctx else node
                elif sign > 0:
                    to, total, made = ctx % 729 * A + sign, cost + extra - lm[ctx * A + sign], (node, sign)
                elif sign == 0 or ctx % A == -sign:
                    to, total, made = ctx, cost + extra, node
                else:
                    continue
                if to not in new or total < new[to][0]:
                    new[to] = (total, made)
        states = new
    ctx = min(states, key=lambda s: states[s][0] - lm[s * A])
    node, letters = states[ctx][1], []
    while node:
        letters.append(" " if node[1] == BORDER else chr(96 + node[1]))
        node = node[0]
    return "".join(reversed(letters))


_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in LEET and chr(c) != WILD) + "«»„“”‘’…–—¿"
_RUNS = re.compile(r"(.)\1+")


def squeeze(word: str) -> str:
    """The word with repeated letters written once."""
    return _RUNS.sub(r"\1", word)


def restore(token: str, lm: list[float]) -> list[str]:
    """The words behind one lower-case token: read as one word and, if signs part it, by its parts."""
    core = token.translate(FOLD).strip(_EDGES)
    if core.isascii() and core.isalpha():
        return [viterbi(core, lm) if _LONG_RUN.search(core) else core]
    if not any("a" <= c <= "z" for c in core) and (_NUMBER.fullmatch(core) or not any(c in LEET and not c.isdigit() for c in core)):
        return []
    parts = _PARTS.findall(core)
    long = [p for p in parts if len(p) > 1] if len(parts) > 1 else []
    found = [viterbi(core, lm), *(p if p.isalpha() else viterbi(p, lm) for p in long)]
    return [w for w in dict.fromkeys(found) if w]


_LONG_RUN = re.compile(r"(.)\1\1")


def squeezed(token: str, lm: list[float]) -> list[str]:
    """The squeezed words behind a token. Letters alone need no decoding: their readings squeeze alike."""
    core = token.translate(FOLD).strip(_EDGES)
    if core.isascii() and core.isalpha():
        return [squeeze(core)]
    return list(dict.fromkeys(map(squeeze, restore(token, lm))))


def restore_run(run: str, lm: list[float]) -> list[str]:
    """The words behind a run of fragments."""
    return viterbi(" ".join(run.translate(FOLD).split()), lm).split()


def restored_text(text: str, lm: list[float]) -> str:
    """The text with every disguised token or run replaced by its likeliest reading."""

    def run(m: re.Match) -> str:
        words, plain = restore_run(m[0], lm), [t.translate(FOLD).strip(_EDGES + "!(") for t in m[0].split()]
        return m[0] if list(map(squeeze, words)) == list(map(squeeze, plain)) or len(words) >= len(plain) else " ".join(words)

    return re.sub(r"\S+", lambda m: m[0] if not (found := restore(m[0], lm)) or found[0] == m[0] else found[0], _RUN.sub(run, text.lower()))


@functools.lru_cache(maxsize=2)
def _as_list(data: bytes) -> list[float]:
    return np.frombuffer(data, np.float32).astype(float).tolist()


def features(word: str) -> list[str]:
    """What is counted of a squeezed word: itself, and marked by a dash each stem that it goes on from."""
    return [word, *(word[:k] + "-" for k in range(STEMS[0], min(len(word) - 1, STEMS[1]) + 1))]


def of_document(found: Iterator[list[str]]) -> set[str]:
    """Features of a document from those of its different tokens; a stem of two of them counts twofold."""
    counts = Counter(f for fs in found for f in fs)
    return set(counts) | {f + "2" for f, n in counts.items() if n > 1 and f[-1] == "-"}


class _Words(dict):
    """Token -> features of the model (or all features) behind it; made anew when large."""

    def __init__(self, lm: list[float], wanted: dict[str, int] | None = None):
        super().__init__()
        self.lm, self.wanted = lm, wanted if wanted is None else {f.rstrip("2") for f in wanted}
        self.starts = {f[: STEMS[0]].rstrip("-") for f in self.wanted or ()}
        masks = sorted({self._mask(f) for f in self.wanted or ()}, key=int.bit_count)
        self.masks = [m for k, m in enumerate(masks) if not any(o & ~m == 0 for o in masks[:k])] if len(masks) <= 4096 else None
        self.inside = ahocorasick.Automaton()
        for f in {f.rstrip("-") for f in self.wanted or ()}:
            self.inside.add_word(f, f)
        if len(self.inside):
            self.inside.make_automaton()

    @staticmethod
    def _mask(word: str) -> int:
        m = 0
        for c in word.rstrip("-2"):
            m |= 1 << ord(c) - 97
        return m

    def _possible(self, token: str) -> bool:
        """Whether the lattice holds all letters of a wanted word; if not, decoding cannot yield one."""
        if self.masks is None:
            return True
        m = 0
        for c in set(token.translate(FOLD)):
            for x in "aeiou" if c == WILD else LEET.get(c, c):
                if "a" <= x <= "z":
                    m |= 1 << ord(x) - 97
        return any(w & ~m == 0 for w in self.masks)

    def _found(self, words: list[str]) -> list[str] | None:
        known = [w for w in words if w[: STEMS[0]] in self.starts]
        return sorted({f for w in known for f in features(w) if f in self.wanted}) or None if known else None

    def __missing__(self, token: str):
        core = token.strip(_EDGES)
        core = core if core.isascii() else core.translate(FOLD).strip(_EDGES)
        if core.isascii() and core.isalpha():  # its readings squeeze alike
            words = [squeeze(core)]
        elif self.wanted is None or self._possible(core):
            words = squeezed(core, self.lm)
        else:
            words = []
        found = [f for w in words for f in features(w)] if self.wanted is None else self._found(words)
        if len(token) <= 64:
            self[token] = found
        return found

    def of_runs(self, low: str) -> list[tuple[str, list[str]]]:
        """Runs of a lower-case text with what is found behind them and not behind one of their fragments."""
        if self.wanted is None:  # all words: only of runs that are surely one word or several set apart
            runs = _SPACED.findall(low)
        elif not len(self.inside):
            return []
        else:
            runs = _RUN.findall(low)
            # without signs to read, a wanted word stands in the run's letters as they are
            if runs and not self._inside("\n".join(runs)):
                runs = [r for r in runs if self._signs(r)]
        out = []
        for run in runs:
            if self.wanted is None or (self._possible(run) if self._signs(run) else self._inside(run)):
                alone = {squeeze(t.strip(_EDGES)) for t in run.split()}
                words = [w for w in map(squeeze, restore_run(run, self.lm)) if w not in alone]
                found = [f for w in words for f in features(w)] if self.wanted is None else self._found(words) if words else None
                if found:
                    out.append((run, found))
        return out

    def _inside(self, run: str) -> bool:
        joined = _LETTERS.sub("", run if run.isascii() else run.translate(FOLD))
        return next(self.inside.iter(squeeze(joined)), None) is not None

    @staticmethod
    def _signs(run: str) -> bool:
        """Whether signs that may stand for letters are in it, beside those that begin or end a fragment as in prose."""
        return any(c in LEET or c == WILD for t in run.split() for c in t.strip(_EDGES + "!("))

    def of_text(self, text: str) -> list[list[str]]:
        """What is found behind each different token and each run."""
        low = text.lower()
        return [*filter(None, map(self.__getitem__, set(low.split()))), *(found for _, found in self.of_runs(low))]


class _WordCounts:
    """Partial document counts of features, of all or of the wanted ones."""

    SCHEMA = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def __init__(self, lm, wanted=None):
        self.lm, self.wanted = lm, wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if self.wanted is None else self.wanted.value
        words = _Words(_as_list(self.lm.value), wanted)
        counts: Counter = Counter()
        for batch in common.slices(batches, 256):
            if len(words) > KNOWN:
                words.clear()
            for text in common.texts(batch):
                found = of_document(words.of_text(text))
                counts.update(found if wanted is None else (f for f in found if f in wanted))
            if len(counts) > HELD:
                yield common.table({"word": list(counts), "n": list(counts.values())}, self.SCHEMA)
                counts.clear()
        yield common.table({"word": list(counts), "n": list(counts.values())}, self.SCHEMA)


class _Contexts:
    """Candidate words with a hash of the tokens around them, by label; copies of a document add nothing."""

    SCHEMA = pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("around", pa.int64())])

    def __init__(self, lm, wanted: dict[str, int]):
        self.lm, self.wanted = lm, wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(_as_list(self.lm.value), self.wanted)
        rows: set = set()

        def flush():
            out = dict(zip(("word", "toxic", "around"), zip(*rows), strict=True)) if rows else {"word": [], "toxic": [], "around": []}
            rows.clear()
            return common.table(out, self.SCHEMA)

        for batch in common.slices(batches, 256):
            if len(words) > KNOWN:
                words.clear()
            for label, text in zip(batch.column("toxic").to_pylist(), common.texts(batch), strict=True):
                low = text.lower()
                tokens = low.split()
                for at, own in enumerate(map(words.__getitem__, tokens)):
                    if own:
                        around = xxhash.xxh64_intdigest(" ".join((*tokens[max(0, at - 1) : at], "\n", *tokens[at + 1 : at + 2]))) >> 1
                        rows.update((f, label, around) for f in own)
                for run, own in words.of_runs(low):
                    rows.update((f, label, xxhash.xxh64_intdigest(run) >> 1) for f in own)
            if len(rows) > HELD:
                yield flush()
        yield flush()


def hits(text: str, words: _Words, wanted: dict[str, int]) -> list[int]:
    """The model's words in a text, by number."""
    found = words.of_text(text)
    return sorted({wanted[f] for f in of_document(found) if f in wanted}) if found else []


class _Hits:
    def __init__(self, lm, wanted: dict[str, int]):
        self.lm, self.wanted = lm, wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(_as_list(self.lm.value), self.wanted)
        for batch in common.slices(batches, 256):
            if len(words) > KNOWN:
                words.clear()
            yield self.answer(batch, [hits(t, words, self.wanted) for t in common.texts(batch)])


class _Features(_Hits):
    SCHEMA = pa.schema([("toxic", pa.int32()), ("hits", pa.list_(pa.int32()))])

    def answer(self, batch, found):
        return common.table({"toxic": batch.column("toxic").to_pylist(), "hits": found}, self.SCHEMA)


class _Scores(_Hits):
    def __init__(self, lm, model: Model, names: list[str], with_text: bool):
        super().__init__(lm, {w: k for k, w in enumerate(model.words)})
        self.model, self.names, self.with_text = model, names, with_text

    def answer(self, batch, found):
        score = [self.model.score(h) for h in found]
        extra = {"score": pa.array(score, pa.float64()), "toxic_words": pa.array([[self.model.words[k] for k in h] for h in found], pa.list_(pa.string()))}
        if self.with_text:
            lm = _as_list(self.lm.value)
            extra["restored"] = pa.array([restored_text(t, lm) for t in common.texts(batch)], pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in self.names), *extra.values()], names=[*self.names, *extra])


class Model:
    """Telling words with their weights, and the character model."""

    def __init__(self, words: list[str], weights: np.ndarray, bias: float, counts: np.ndarray):
        self.words, self.weights, self.bias = words, [float(w) for w in weights], float(bias)
        extra = np.zeros(A**4, np.int64)
        if words:
            extra = char_counts(" ".join(w for w in words if w.isalpha())) * max(1, int(counts.reshape(-1, A)[:, 0].sum() // (100 * len(words))))
        self.lm = language_model(counts + extra).astype(np.float32)

    def score(self, found: list[int]) -> float:
        if self.bias == -np.inf:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[k] for k in found), -40, 40))))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on weighted rows by Newton steps; the bias is not penalised."""
    x1 = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x1.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (weight * (p * (1 - p) + 1e-9))[:, None]) + np.diag(penalty), x1.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], w[-1]


def is_telling(m0: float, m1: float, n0: int, n1: int) -> bool:
    """Whether a word in ``m1`` of ``n1`` toxic and ``m0`` of ``n0`` other documents tells toxic ones."""
    ratio = np.log((m1 + 0.5) / (n1 + 1)) - np.log((m0 + 0.5) / (n0 + 1))
    return m1 >= LEAST and ratio - ERRORS * np.sqrt(1 / (m1 + 0.5) + 1 / (m0 + 0.5)) > np.log(RATIO)


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """``docs``: every text, for the character model; ``labels``: doc_id, toxic of the rows to learn from."""
    spark = docs.sparkSession
    counts = np.zeros(A**4, np.int64)
    for r in docs.select("text").mapInArrow(_CharCounts(), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    lm = spark.sparkContext.broadcast(language_model(counts).astype(np.float32).tobytes())
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {y: min(1.0, fit_rows / 2 / n) for y, n in total.items()}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, F.lit(1e6 * rate.get(1, 0.0))).otherwise(F.lit(1e6 * rate.get(0, 0.0)))
    # about fit_rows rows of two numbers, whatever the size of the tables
    fit = common.materialise(docs.select("doc_id", "text").join(F.broadcast(labels.where(drawn)), "doc_id").select("text", "toxic"), "labelled")
    n = {r.toxic: r.n for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model([], np.zeros(0), -np.inf, counts)

    def counted(label: int, wanted=None) -> DataFrame:
        rows = fit.where(F.col("toxic") == label).select("text").mapInArrow(_WordCounts(lm, wanted), "word string, n bigint")
        return rows.groupBy("word").agg(F.sum("n").alias("n"))

    in_toxic = {r.word: r.n for r in counted(1).where(F.col("n") >= LEAST).collect()}
    in_clean = {r.word: r.n for r in counted(0, spark.sparkContext.broadcast(dict.fromkeys(in_toxic))).collect()} if in_toxic else {}
    first = sorted(w for w, m in in_toxic.items() if is_telling(in_clean.get(w, 0), m, n0, n1))
    contexts = fit.mapInArrow(_Contexts(lm, {w: k for k, w in enumerate(first)}), "word string, toxic int, around bigint") if first else None
    around = {(r.word, r.toxic): r.n for r in contexts.groupBy("word", "toxic").agg(F.countDistinct("around").alias("n")).collect()} if first else {}
    once = lambda w, y, m: min(m, around.get((w.rstrip("2"), y), 0))
    telling = [w for w in first if is_telling(once(w, 0, in_clean.get(w, 0)), once(w, 1, in_toxic[w]), n0, n1)]
    model = Model(telling, np.zeros(len(telling)), 0.0, counts)
    lm = spark.sparkContext.broadcast(model.lm.tobytes())
    rows = fit.mapInArrow(_Features(lm, {w: k for k, w in enumerate(telling)}), "toxic int, hits array<int>").groupBy("toxic", "hits").agg(F.count("*").alias("n")).collect()
    x, y, weight = np.zeros((len(rows), len(telling)), np.float32), np.zeros(len(rows)), np.zeros(len(rows))
    for k, r in enumerate(rows):
        x[k, r.hits], y[k], weight[k] = 1, r.toxic, r.n / rate[r.toxic]
    model.weights, model.bias = (lambda w, b: (w.tolist(), float(b)))(*fit_logistic(x, y, weight))
    return model


def score(docs: DataFrame, model: Model, with_text: bool = False) -> DataFrame:
    """doc_id, score, toxic_words, and with ``with_text`` the restored text."""
    lm = docs.sparkSession.sparkContext.broadcast(model.lm.tobytes())
    ddl = "doc_id bigint, score double, toxic_words array<string>" + ", restored string" * with_text
    return docs.select("doc_id", "text").mapInArrow(_Scores(lm, model, ["doc_id"], with_text), ddl)
