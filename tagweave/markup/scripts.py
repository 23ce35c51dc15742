"""Small helpers on strings: packed scripts, entity tables, selectors of elements."""

from __future__ import annotations

import itertools
import re
import string
from html.entities import html5

from tagweave.markup.tree import Node

_PACKED = re.compile(r"eval\(function\(p,a,c,k,e,[dr]\).*?\}\('(.*?[^\\])',(\d+),(\d+),'(.*?)'\.split\('\|'\)", re.S)
_SIGNS = string.digits + string.ascii_lowercase + string.ascii_uppercase


def number(text: str, radix: int) -> int:
    """A number written in a radix from 2 to 62 with digits and letters, or to 95 with the printable signs in order."""
    value, signs = 0, _SIGNS if radix <= 62 else "".join(map(chr, range(32, 127)))
    for c in text:
        digit = signs.find(c)
        if not 0 <= digit < radix:
            raise ValueError(f"{text!r} is not a number of radix {radix}")
        value = value * radix + digit
    return value


def unpack(script: str) -> str:
    """The source of a script packed as payload and dictionary; any other script as it is."""
    m = _PACKED.search(script)
    if not m:
        return script
    payload, radix, words = m[1].replace("\\'", "'").replace("\\\\", "\\"), int(m[2]), m[4].split("|")

    def word(w: re.Match) -> str:
        try:
            k = number(w[0], radix)
        except ValueError:
            return w[0]
        return words[k] if k < len(words) and words[k] else w[0]

    return re.sub(r"\b\w+\b", word, payload)


def is_named_entity(name: str) -> bool:
    return name + ";" in html5 or name in html5


def is_base_entity(name: str) -> bool:
    """Whether a reference to it may go without semicolon."""
    return name in html5


def entity(name: str) -> str:
    """The characters of a named reference, or ""."""
    return html5.get(name + ";", html5.get(name, ""))


def css_escape(name: str) -> str:
    """A name as a CSS identifier."""
    out = []
    for k, c in enumerate(name):
        if c == "\0":
            out.append("�")
        elif c < " " or c == "\x7f" or (c.isascii() and c.isdigit() and (k == 0 or (k == 1 and name[0] == "-"))):
            out.append(f"\\{ord(c):x} ")
        elif (c == "-" and len(name) == 1) or (c.isascii() and not c.isalnum() and c not in "-_"):
            out.append("\\" + c)
        else:
            out.append(c)
    return "".join(out)


def css_selectors(root: Node, found: list[Node]) -> list[str]:
    """For each of the elements of a document a selector: by its id if no other element has it, else the path
    from the root, with places where siblings have the same tag and classes."""
    ids: dict[str, int] = {}
    for n in root.walk():
        if n.kind == "element" and n.attr("id"):
            ids[n.attr("id")] = ids.get(n.attr("id"), 0) + 1
    steps: dict[int, str] = {}
    return [css_selector(e, root, ids, steps) for e in found]


def css_selector(e: Node, root: Node, ids: dict[str, int] | None = None, steps: dict[int, str] | None = None) -> str:
    """A selector of one element, as ``css_selectors``."""
    if ids is None:
        return css_selectors(root, [e])[0]
    own = e.attr("id")
    if own and ids[own] == 1:
        return "#" + css_escape(own)
    path = []
    while e is not None and e.kind == "element":
        if id(e) not in steps:
            _name_children(e, steps)
        path.append(steps[id(e)])
        e = e.parent
    return " > ".join(reversed(path))


def _name_children(e: Node, steps: dict[int, str]) -> None:
    """Steps of an element and all its siblings."""
    siblings = e.parent.elements() if e.parent is not None and e.parent.kind == "element" else [e]
    classes = [frozenset((s.attr("class") or "").lower().split()) for s in siblings]
    holders: dict[tuple[str, str], set[int]] = {}
    for k, (s, own) in enumerate(zip(siblings, classes, strict=True)):
        for c in (*own, ""):
            holders.setdefault((s.tag, c), set()).add(k)
    for k, s in enumerate(siblings):
        names = list(dict.fromkeys((s.attr("class") or "").split()))
        step = css_escape(s.raw_tag).replace("\\:", "|") + "".join("." + css_escape(c) for c in names)
        few, *others = sorted((holders[s.tag, c.lower()] for c in names or [""]), key=len)
        alike = sum(1 for _ in itertools.islice((j for j in few if all(j in o for o in others)), 2))
        steps[id(s)] = step + (f":nth-child({k + 1})" if alike > 1 else "")
