"""What the engine knows of HTML tag names and text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

_words = lambda s: frozenset(s.split())

# Tags that text extraction and output treat as blocks, and the tag sets that tree construction goes by.
BLOCK = _words(
    "html head body frameset script noscript style meta link title frame noframes section nav aside hgroup header footer p h1 h2 h3 h4 h5 h6 "
    "ul ol pre div blockquote hr address figure figcaption form fieldset ins del dl dt dd li table caption thead tfoot tbody colgroup col tr th td "
    "video audio canvas details menu plaintext template article main svg math center dir applet marquee listing summary search dialog"
)
VOID = _words("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr")
FORMAT_INLINE = _words("title a p h1 h2 h3 h4 h5 h6 pre address li th td script style ins del s button")
KEEP_SPACE = _words("pre plaintext title textarea")
INLINE = _words(
    "object base font tt i b u big small em strong dfn code samp kbd var cite abbr time acronym mark ruby rt rp rtc rb a img br wbr map q sub sup bdo iframe embed "
    "span input select textarea label optgroup option legend datalist keygen output progress meter area param source track s strike nobr basefont bgsound command "
    "device audio video command data bdi slot image"
)
#: Elements with rules of their own; others can close themselves.
KNOWN = BLOCK | INLINE
#: What may be open at the end of a body without an error.
MAY_STAY_OPEN = _words("body dd dt html li optgroup option p rb rp rt rtc tbody td tfoot th thead tr")
FORM_LISTED = _words("button fieldset input keygen object output select textarea")
FORM_SUBMIT = _words("input keygen object select textarea")
FORMATTING = _words("b big code em font i s small strike strong tt u")
P_CLOSERS = _words("address article aside blockquote center details dir div dl fieldset figcaption figure footer header hgroup menu nav ol p section summary ul")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
SPECIAL = _words(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup command dd details dir div dl dt "
    "embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input isindex li link listing "
    "marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script section select style summary table tbody td textarea tfoot "
    "th thead title tr ul wbr xmp"
)
IMPLIED_END = _words("dd dt li optgroup option p rb rp rt rtc")
THOROUGH_END = IMPLIED_END | _words("caption colgroup tbody td tfoot th thead tr")
SCOPE = _words("applet caption html marquee object table td th template mi mo mn ms mtext annotation-xml foreignobject desc title")
TABLE_PARTS = _words("caption col colgroup tbody td tfoot th thead tr")
BOOLEAN_ATTRS = _words(
    "allowfullscreen async autofocus checked compact declare default defer disabled formnovalidate hidden inert ismap itemscope multiple muted nohref "
    "noresize noshade novalidate nowrap open readonly required reversed seamless selected sortable truespeed typemustmatch"
)
FOREIGN_BREAKOUT = _words(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var"
)

#: Code points that windows-1252 has where HTML numbers 0x80-0x9F are C1 controls.
C1 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([A-Za-z0-9]+)(;?))")


def _one(m: re.Match, in_attribute: bool) -> str:
    if m[1] or m[2]:
        digits = m[1] or m[2]
        n = int(digits, 16 if m[1] else 10) if len(digits) < 12 else 0x110000
        if n in C1:
            return C1[n]
        return "�" if n > 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n)
    if m[4]:
        return html5.get(m[3] + ";", m[0])
    if m[3] not in html5 or (in_attribute and m.string[m.end() : m.end() + 1] in ("=", "-", "_")):
        return m[0]
    return html5[m[3]]


def reference_errors(text: str, in_attribute: bool = False) -> Iterator[tuple[int, str]]:
    """(place, message) of the character references that are not as they should be."""
    for m in _REFERENCE.finditer(text):
        if m[1] or m[2]:
            digits = m[1] or m[2]
            if not m[0].endswith(";"):
                yield m.end(), f"missing semicolon on [{m[0]}]"
            n = int(digits, 16 if m[1] else 10) if len(digits) < 20 else 0x110000
            if n > 0x10FFFF or 0xD800 <= n < 0xE000:
                yield m.end(), f"character [{n}] outside of valid range"
            elif n in C1:
                yield m.end(), f"character [{n}] is not a valid unicode code point"
        elif m[4]:
            if m[3] + ";" not in html5:
                yield m.start() + 1, f"invalid named reference [{m[3]}]"
        elif m[3] in html5 and not (in_attribute and text[m.end() : m.end() + 1] in ("=", "-", "_")):
            yield m.end(), f"missing semicolon on [&{m[3]}]"


def unescape(text: str, in_attribute: bool = False) -> str:
    """Character references decoded: a name must match as a whole, and without semicolon be a base name."""
    return _REFERENCE.sub(lambda m: _one(m, in_attribute), text) if "&" in text else text


_NAMES: dict[str, str] = {}
for _name in sorted(html5, key=lambda n: (not n.islower(), len(n), n)):
    if _name.endswith(";") and len(html5[_name]) == 1:
        _NAMES.setdefault(html5[_name], _name[:-1])
BASE_NAMES = {c: n for n, c in ((n, html5[n]) for n in sorted(html5, key=lambda n: (n.isupper(), n)) if not n.endswith(";")) if n not in ("AMP", "LT", "GT", "QUOT", "COPY", "REG")}


def escape(text: str, mode: str = "base", in_attribute: bool = False, charset: str = "utf-8") -> str:
    """Text for output: ``xhtml`` knows the XML names only, ``base`` those without semicolon, ``extended`` all."""
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace("\xa0", "&#xa0;" if mode == "xhtml" else "&nbsp;")
    out = out.replace('"', "&quot;") if in_attribute else out.replace(">", "&gt;")
    if in_attribute and mode != "xhtml":
        out = out.replace("&lt;", "<")
    if charset.lower().replace("-", "") in ("utf8", "utf16", "utf16le", "utf16be", "utf32"):
        return out
    names = {} if mode == "xhtml" else BASE_NAMES if mode == "base" else _NAMES

    def sign(c: str) -> str:
        try:
            c.encode(charset)
            return c
        except UnicodeEncodeError:
            return f"&{names[c]};" if c in names else f"&#x{ord(c):x};"

    return "".join(c if ord(c) < 128 else sign(c) for c in out)


SPACE = " \t\n\f\r"
_SPACES = re.compile("[ \t\n\f\r\xa0]+")
_INVISIBLE = re.compile("[​­]")


def is_blank(text: str | None) -> bool:
    """Nothing but space, tab, line feed, form feed, return; a no-break space is not blank."""
    return not text or not text.strip(SPACE)


def normalise(text: str) -> str:
    """Runs of white space, no-break spaces too, as one space; zero-width space and soft hyphen dropped."""
    return _INVISIBLE.sub("", _SPACES.sub(" ", text))
