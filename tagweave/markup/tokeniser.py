"""Markup as a stream of tokens (kind, name, attributes or text, closed by itself)."""

from __future__ import annotations

import re
from typing import NamedTuple

from tagweave.markup.tags import reference_errors, unescape


class Token(NamedTuple):
    kind: str  # start end text comment doctype cdata eof
    name: str = ""
    attrs: tuple = ()
    closed: bool = False
    start: int = 0
    end: int = 0
    ranges: tuple = ()  # of attributes: (name, name start, name end, value start, value end)


_NAME = re.compile(r"[^\t\n\f\r />\0<]*")
_ATTR = re.compile(r"[\t\n\f\r /]*(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\t\n\f\r >]*)))?)")
_DOCTYPE = re.compile(r"[\t\n\f\r ]*([^\t\n\f\r >]*)[\t\n\f\r ]*(?:(public|system)[\t\n\f\r ]*(?:\"([^\">]*)\"|'([^'>]*)')?[\t\n\f\r ]*(?:\"([^\">]*)\"|'([^'>]*)')?)?([^>]*)(>?)", re.I)


class Tokeniser:
    """Pulls tokens; the tree builder sets ``raw`` to the element whose text is to be read without markup."""

    def __init__(self, text: str, xml: bool = False, errors: list | None = None):
        self.text, self.at, self.xml = text, 0, xml
        self.raw: tuple[str, bool] | None = None  # (element, whether references are decoded)
        self.foreign = False
        self.errors = errors

    def error(self, at: int, message: str) -> None:
        if self.errors is not None:
            self.errors.append((at, message))

    def next(self) -> Token:
        text, at = self.text, self.at
        if at >= len(text):
            return Token("eof", start=at, end=at)
        if self.raw:
            return self._raw(*self.raw)
        if text[at] != "<":
            return self._text(text.find("<", at))
        after = text[at + 1 : at + 2]
        if after.isalpha() and after.isascii() or self.xml and after and after in "_:":
            return self._tag(at + 1, "start")
        if after == "/":
            first = text[at + 2 : at + 3]
            if first.isalpha() and first.isascii() or self.xml and first and first in "_:":
                return self._tag(at + 2, "end")
            if first == ">":
                self.error(at + 2, "Unexpected character '>' in input state [EndTagOpen]")
                self.at = at + 3
                return self.next()
            if first:
                return self._bogus(at, at + 2)
        elif after == "!":
            if text.startswith("<!--", at):
                return self._comment(at)
            if text[at + 2 : at + 9].lower() == "doctype":
                return self._doctype(at)
            if text.startswith("<![CDATA[", at) and (self.xml or self.foreign):
                end = text.find("]]>", at)
                self.at = len(text) if end < 0 else end + 3
                return Token("cdata", text[at + 9 : end if end >= 0 else len(text)], start=at, end=self.at)
            return self._bogus(at, at + 2)
        elif after == "?":
            return self._declaration(at) if self.xml else self._bogus(at, at + 1)
        self.error(at + 1, f"Unexpected character '{after}' in input state [TagOpen]" if after else "Unexpectedly reached end of file (EOF) in input state [TagOpen]")
        return self._text(text.find("<", at + 1))

    def _text(self, end: int) -> Token:
        start, end = self.at, len(self.text) if end < 0 else end
        self.at = end
        return Token("text", self._decoded(start, end), start=start, end=end)

    def _decoded(self, start: int, end: int, in_attribute: bool = False) -> str:
        text = self.text[start:end]
        if self.errors is not None and "&" in text:
            for at, message in reference_errors(text, in_attribute):
                self.error(start + at, f"Invalid character reference: {message}")
        return unescape(text, in_attribute)

    def _raw(self, element: str, references: bool) -> Token:
        start, text = self.at, self.text
        if element == "plaintext":
            self.at = len(text)
            return Token("text", text[start:], start=start, end=self.at)
        pattern = re.compile(rf"</{re.escape(element)}(?=[\t\n\f\r />])", re.I)
        found = pattern.search(text, start)
        if element == "script" and found:  # a script inside a comment may hold end tags
            opened = text.find("<!--", start, found.start())
            if opened >= 0 and (inner := re.compile(r"<script(?=[\t\n\f\r />])", re.I).search(text, opened, found.start())) and text.find("-->", inner.start(), found.start()) < 0:
                second = pattern.search(text, found.end())
                found = second or found
        if found and found.start() == start:
            self.raw = None
            return self._tag(start + 2, "end")
        self.at = found.start() if found else len(text)
        body = text[start : self.at]
        return Token("text", self._decoded(start, self.at) if references else body, start=start, end=self.at)

    def _tag(self, at: int, kind: str) -> Token:
        start, text = self.at, self.text
        m = _NAME.match(text, at)
        if m.end() >= len(text):
            self.error(len(text) + 1, "Unexpectedly reached end of file (EOF) in input state [TagName]")
            self.at = len(text)
            return Token("eof", start=self.at, end=self.at)
        name, at, attrs, ranges = m[0].replace("\0", "�"), m.end(), [], []
        while True:
            if text[at : at + 1] == "<" and at == m.end():  # the next tag ends this one
                break
            a = _ATTR.match(text, at)
            if not a:
                self.error(len(text) + 1, "Unexpectedly reached end of file (EOF) in input state [BeforeAttributeName]")
                self.at = len(text)
                return Token("eof", start=self.at, end=self.at)
            at = a.end()
            if a[1]:
                break
            if a[3] is not None:
                value, whole = a[3], a[4]
            elif a[5] is not None:
                value, whole = a[5], a[6]
            else:
                value, whole = a[7], "x"
            if not whole or at >= len(text):
                self.error(len(text) + 1, f"Unexpectedly reached end of file (EOF) in input state [{'TagName' if at == len(text) and a[2] is None else 'AttributeValue' if not whole else 'AttributeName'}]")
                self.at = len(text)
                return Token("eof", start=self.at, end=self.at)
            group = 3 if a[3] is not None else 5 if a[5] is not None else 7
            ranges.append((a[2], *a.span(2), *(a.span(group) if value is not None else (a.end(2), a.end(2)))))
            attrs.append((a[2].replace("\0", "�"), None if value is None else self._decoded(*a.span(group), True)))
        self.at = at
        if kind == "end" and attrs:
            self.error(at, f"Attributes incorrectly present on end tag [/{name.lower()}]")
        closed = text[at - 2 : at] == "/>" and not (attrs and text[at - 2] == attrs[-1][1][-1:] if attrs and attrs[-1][1] else False)
        return Token(kind, name, tuple(attrs), closed, start, at, tuple(ranges))

    def _comment(self, at: int) -> Token:
        text = self.text
        for short in ("<!-->", "<!--->"):
            if text.startswith(short, at):
                self.at = at + len(short)
                return Token("comment", "", start=at, end=self.at)
        m = re.compile(r"--!?>").search(text, at + 4)
        self.at = m.end() if m else len(text)
        if not m:
            self.error(len(text), "Unexpectedly reached end of file (EOF) in input state [Comment]")
        return Token("comment", text[at + 4 : m.start() if m else len(text)], start=at, end=self.at)

    def _bogus(self, at: int, body: int) -> Token:
        self.error(body, "Unexpected character in input state [BogusComment]")
        end = self.text.find(">", body)
        self.at = len(self.text) if end < 0 else end + 1
        return Token("comment", self.text[body : end if end >= 0 else len(self.text)], start=at, end=self.at)

    def _declaration(self, at: int) -> Token:
        end = self.text.find("?>", at)
        self.at = len(self.text) if end < 0 else end + 2
        return Token("declaration", self.text[at + 2 : end if end >= 0 else len(self.text)], start=at, end=self.at)

    def _doctype(self, at: int) -> Token:
        m = _DOCTYPE.match(self.text, at + 9)
        self.at = m.end()
        first, second = (m[3] if m[3] is not None else m[4]), (m[5] if m[5] is not None else m[6])
        public = (m[2] or "").lower() == "public"
        ids = (first or "", second or "") if public else ("", first or "")
        quirks = not m[1] or not m[8]
        return Token("doctype", m[1] if self.xml else m[1].lower(), (*ids, (m[2] or "").upper()), quirks, at, self.at)
