"""License scans with a positional rare-token index (operator 3).

The index has the words of license notices with their positions. Of each notice the words rarest over
all documents (highest inverse document frequency) are its anchors. Only anchors are looked up in a file:
each occurrence votes for every (notice, shift) at which the notice would lie so; shifts with enough votes
are verified word by word, and the mandatory key phrase must stand there in full. A phrase whose words
must all stand consecutively has its rarest word as anchor, so that none of its places is missed.

Defined results: null text counts as empty and has no words, places or labels and score 0; repeated rows
repeat; overlapping places all count; an empty table gives no rows; columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import common

#: Bytes that end a word, after lower-casing A-Z: all ASCII but digits and a-z.
_BLANKS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
ANCHORS, COVERED = 4, 0.8


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    key: str  # stands in ``text``; must be present word for word
    whole: bool = False  # all of the words must be present: a phrase


# Phrases with their labels, and the opening words of public license notices.
PHRASES = (
    Notice("cc-by", "cc by", "cc by", True),
    Notice("gpl", "general public license", "general public license", True),
    Notice("reserved", "all rights reserved", "all rights reserved", True),
)
NOTICES = (
    Notice("agpl-3.0", "licensed under the gnu affero general public license", "affero general public license"),
    Notice("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Notice("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    Notice("artistic-2.0", "under the terms of the artistic license 2 0", "artistic license"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    Notice("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "may be used to endorse or promote products"),
    Notice("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Notice("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Notice("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    Notice("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    Notice("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    Notice("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd"),
    Notice("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    Notice("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Notice("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work to the public domain"),
    Notice("cddl-1.0", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    Notice("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Notice("gpl-2.0", "as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    Notice("gpl-3.0", "as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    Notice("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    Notice("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    Notice("mit", "released under the mit license", "mit license"),
    Notice("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    Notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Notice("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
)


def words_of(text: str) -> list[bytes]:
    """Lower-case words, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split()


class Index:
    """Postings (notice, position) of the anchors of every notice."""

    def __init__(self, notices: tuple[Notice, ...], frequency: dict[bytes, int], documents: int, anchors: int = ANCHORS):
        self.notices = notices
        self.words = [words_of(n.text) for n in notices]
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for ws in self.words for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.votes, self.keys = [], []
        for k, (notice, words) in enumerate(zip(notices, self.words, strict=True)):
            rare = sorted(range(len(words)), key=lambda q: (-self.idf[words[q]], q))[: 1 if notice.whole else anchors]
            for q in rare:
                self.postings[words[q]].append((k, q))
            self.votes.append(len(rare) if notice.whole else -(-len(rare) // 2))
            key = words_of(notice.key)
            at = next(q for q in range(len(words)) if words[q : q + len(key)] == key)
            self.keys.append((at, key))
        self.anchors = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(notice, start, share of its words that stand there) of each verified place."""
        if self.anchors.isdisjoint(words):
            return []
        votes: Counter = Counter()
        for p, w in enumerate(words):
            if w in self.anchors:
                votes.update((k, p - q) for k, q in self.postings[w])
        found = []
        for (k, shift), n in votes.items():
            own, (at, key) = self.words[k], self.keys[k]
            if n < self.votes[k] or shift + at < 0 or words[shift + at : shift + at + len(key)] != key:
                continue
            same = sum(0 <= shift + q < len(words) and words[shift + q] == w for q, w in enumerate(own))
            if same == len(own) or not self.notices[k].whole and same >= COVERED * len(own):
                found.append((k, max(shift, 0), same / len(own)))
        return sorted(found)


class _Frequencies:
    SCHEMA = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def __init__(self, vocabulary: frozenset):
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in common.slices(batches):
            for text in common.texts(batch):
                counts[b""] += 1
                counts.update(self.vocabulary.intersection(words_of(text)))
        yield common.table({"word": list(counts), "n": list(counts.values())}, self.SCHEMA)


class _Scan:
    SCHEMA = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("notice", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("share", pa.float64())]))),
    ])

    def __init__(self, index: Index):
        self.index = index

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = self.index
        for batch in common.slices(batches):
            n_words, places = [], []
            for text in common.texts(batch):
                words = words_of(text)
                n_words.append(len(words))
                places.append([{"notice": k, "label": index.notices[k].label, "start": s, "words": len(index.words[k]), "share": share} for k, s, share in index.scan(words)])
            yield common.table({"doc_id": batch.column("doc_id").to_pylist(), "n_words": n_words, "places": places}, self.SCHEMA)


def build_index(docs: DataFrame, notices: tuple[Notice, ...] = PHRASES + NOTICES, anchors: int = ANCHORS) -> Index:
    """Document frequencies over all documents, one count for each word of the notices."""
    vocabulary = frozenset(w for n in notices for w in words_of(n.text))
    rows = docs.select("text").mapInArrow(_Frequencies(vocabulary), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {bytes(r.word): r.n for r in rows}
    return Index(notices, frequency, frequency.pop(b"", 0), anchors)


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words and places: array of (notice, label, start word, words, share)."""
    ddl = "doc_id bigint, n_words bigint, places array<struct<notice:int,label:string,start:bigint,words:int,share:double>>"
    return docs.select("doc_id", "text").mapInArrow(_Scan(index), ddl)


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: places of the phrases, labels of the phrases and of all notices, best share."""
    base = F.filter("places", lambda p: p["notice"] < len(PHRASES))
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
