"""Exact byte-level BPE encoding with the ``tokenizers`` library, fast enough for whole corpora.

The library's own ``encode_batch`` aligns every character, which costs about a microsecond each.
Here a text is cut only where no pre-token can span the cut, and each distinct chunk goes once
through the library's BPE model; its ids are remembered in a bounded table per Python worker.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

from tagweave.llm import common

# The pre-token pattern that the byte-level scheme of the vocabulary files defines.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space in any of the libraries' senses, and characters that some of them count as such.
_SPACE = r"\s\x1c-\x1f\x85᠎​⁠﻿"
_SPACES = re.compile(f"[{_SPACE}]")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without the apostrophe, with which suffixes begin
_CUT = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 as it is, the rest from U+0100 up."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Chunks(dict):
    """Chunk -> ids as bytes (unsigned 32 bits each); None if it is empty or has white space at an end, so that a text can't
    be cut around it. Emptied when it has ``most`` entries.

    ``lead`` is what stands before a chunk: nothing, or the blank at which the text was cut.
    """

    def __init__(self, lead: str, encoder: Encoder, most: int):
        super().__init__()
        self.lead, self.encoder, self.most = lead, encoder, most
        self.lead_letter = encoder.letters[0x20] if lead else ""

    def __missing__(self, chunk: str) -> bytes | None:
        found = self._ids(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = found
        return found

    def _ids(self, chunk: str) -> bytes | None:
        enc = self.encoder
        if chunk.isalpha():  # the same letters as \p{L}: one pre-token
            letters = chunk if chunk.isascii() else chunk.encode("utf-8").decode("latin-1").translate(enc.letters)
            return b"".join([enc.id_bytes[t.id] for t in enc.tokenize(self.lead_letter + letters)])
        word = chunk.rstrip(_MARKS)
        if word.isalpha():  # marks are one more pre-token
            return self[word] + enc.marks(chunk[len(word) :])
        if not chunk or _SPACES.match(chunk[0]) or _SPACES.match(chunk[-1]):
            return None
        return self.plainly(chunk)

    def plainly(self, chunk: str) -> bytes:
        return b"".join([self.encoder.piece(p) for p in self.encoder.pattern.findall(self.lead + chunk)])


class Encoder:
    """Ids of a text under one vocabulary file. Strings of added tokens count as ordinary text, or with
    ``special`` as the library reads them by default: a text that holds one goes through the library as a whole."""

    def __init__(self, path: str, most: int = 500_000, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]] if special else []
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        pre = spec.get("pre_tokenizer") or {}
        self.plain = not (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and spec["model"].get("type") == "BPE" and not spec.get("truncation")
        )
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.pattern = regex.compile(PRETOKEN)
        self.size = self.tokenizer.get_vocab_size()
        self.id_bytes = [k.to_bytes(4, "little") for k in range(self.size)]
        self.line, self.seen = b"" if self.plain else self.piece("\n"), {}
        self.first, self.later = _Chunks("", self, most // 16), _Chunks(" ", self, most)

    def piece(self, piece: str) -> bytes:
        letters = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.tokenize(letters)])

    def marks(self, tail: str) -> bytes:
        found = self.seen.get(tail)
        if found is None:
            found = self.piece(tail)
            if len(tail) <= 8:
                if len(self.seen) >= 10_000:
                    self.seen.clear()
                self.seen[tail] = found
        return found

    def raw(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.plain or (self.added is not None and self.added.search(text)):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # a line break between two characters that are not white space is a pre-token of its own
        lines = [line.split(" ") for line in text.split("\n")]
        try:
            return self.line.join([self.first[p[0]] + b"".join(map(self.later.__getitem__, p[1:])) for p in lines])
        except TypeError:  # a None: white space beside white space or at an end
            pass
        parts, table, out = _CUT.split(text), self.first, []
        for part in parts:
            found = table[part]
            out.append(table.plainly(part) if found is None else found)
            table = self.later
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str, most: int = 500_000, special: bool = False) -> Encoder:
    """The worker's encoder; it outlives a task, and its table takes about 200 bytes for each chunk."""
    return Encoder(path, most, special)


def _forget() -> bool:
    held = encoder.cache_info().currsize > 0
    encoder.cache_clear()
    return held


common.kept(_forget)
