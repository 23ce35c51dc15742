"""Selector plans on one document."""

from __future__ import annotations

import re

from tagweave.markup import tags as T
from tagweave.markup import text as X
from tagweave.markup.tree import Node
from tagweave.markup.urls import resolve
from tagweave.plans import selector as S

_TEXTS = {"text": X.text, "own": X.own_text, "whole": X.whole_text, "whole_own": X.whole_own_text, "data": X.data}


def attribute(node: Node, key: str, base: str) -> str | None:
    """An attribute's value; ``abs:name`` is its absolute URL, if it has one."""
    if key.startswith("abs:"):
        value = node.attr(key[4:])
        return (resolve(base, value) or None) if value is not None else None
    return node.attr(key)


def nth_matches(step: int, offset: int, place: int) -> bool:
    return place == offset if step == 0 else (place - offset) * step >= 0 and (place - offset) % step == 0


class Matcher:
    """Tests elements against a plan below ``root``; inner results are remembered."""

    def __init__(self, root: Node, base: str = ""):
        self.root, self.base = root, base
        self.memo: dict[tuple[int, int], bool] = {}
        self.holders: dict[int, set[int]] = {}
        self.firsts: dict[tuple[int, int], float] = {}
        self.siblings: dict[int, list[Node]] = {}
        self.places: dict[int, tuple[int, int, int, int]] = {}

    def place(self, e: Node) -> tuple[int, int, int, int]:
        """(index, count) among element siblings, and among those of the same tag."""
        if id(e) not in self.places:
            siblings = self.line(e)
            seen: dict[str, int] = {}
            rows = []
            for k, s in enumerate(siblings):
                seen[s.tag] = seen.get(s.tag, 0) + 1
                rows.append((s, k, seen[s.tag]))
            for s, k, t in rows:
                self.places[id(s)] = (k, len(siblings), t, seen[s.tag])
        return self.places[id(e)]

    def line(self, e: Node) -> list[Node]:
        """The elements of its parent."""
        if e.parent is None:
            return [e]
        if id(e.parent) not in self.siblings:
            self.siblings[id(e.parent)] = e.parent.elements()
        return self.siblings[id(e.parent)]

    def holding(self, p, how: str, plan) -> set[int]:
        """All elements of the document that stand in a relation to some element that matches, found in one walk."""
        if id(p) not in self.holders:
            top, found = self.root, set()
            while top.parent is not None:
                top = top.parent
            for n in top.walk():
                if n.kind != "element" or not self.test(plan, n):
                    continue
                if how == "ancestor":
                    up = n.parent
                    while up is not None and id(up) not in found:
                        found.add(id(up))
                        up = up.parent
                elif how == "parent":
                    found.add(id(n.parent))
                elif how == "previous":
                    found.update(id(s) for s in self.line(n)[max(0, self.place(n)[0] - 1) : self.place(n)[0]])
                else:
                    for s in reversed(self.line(n)[: self.place(n)[0]]):
                        if id(s) in found:
                            break
                        found.add(id(s))
            self.holders[id(p)] = found
        return self.holders[id(p)]

    def test(self, p, e: Node) -> bool:
        if isinstance(p, S.Test):
            return self.simple(p.name, p.args, e)
        if isinstance(p, S.All):
            return all(self.test(q, e) for q in p.parts)
        if isinstance(p, S.Any):
            return any(self.test(q, e) for q in p.parts)
        key = (id(p), id(e))
        if key not in self.memo:
            self.memo[key] = self.structural(p, e)
        return self.memo[key]

    def structural(self, p, e: Node) -> bool:
        if isinstance(p, S.Not):
            return not self.test(p.inner, e)
        if isinstance(p, S.Is):
            return self.test(p.inner, e)
        if isinstance(p, S.Has):
            if (simple := S.one_relation(p.inner)) is not None:
                return id(e) in self.holding(p, *simple)
            here = Matcher(e, self.base)
            if p.sibling and e.parent is not None and any(here.test(p.inner, s) for s in self.line(e)[self.place(e)[0] + 1 :]):
                return True
            return any(n.kind == "element" and n is not e and here.test(p.inner, n) for n in e.walk())
        scoped = p.left == S.Test("scope")
        if e is self.root:
            return False
        if p.how in ("before", "previous"):
            if e.parent is None:
                return False
            siblings, at = self.line(e), self.place(e)[0]
            hit = (lambda s: s is self.root) if scoped else (lambda s: self.test(p.left, s))
            if p.how == "previous":
                return at > 0 and hit(siblings[at - 1])
            key = (id(p), id(e.parent))
            if key not in self.firsts:  # siblings come in order, so the first that matches tells for all
                self.firsts[key] = next((k for k, s in enumerate(siblings) if hit(s)), float("inf"))
            return self.firsts[key] < at
        if p.how == "parent":
            up = e.parent
            return up is not None and up.kind in ("element", "document") and ((up is self.root) if scoped else up.kind == "element" and self.test(p.left, up))
        return self.inside(p, scoped, e)

    def inside(self, p, scoped: bool, e: Node) -> bool:
        """Whether an ancestor up to the root matches; what is found holds for all on the way."""
        way, up, found = [e], e.parent, False
        while up is not None and up.kind in ("element", "document"):
            if (up is self.root) if scoped else (up.kind == "element" and self.test(p.left, up)):
                found = True
                break
            if up is self.root:
                break
            if (known := self.memo.get((id(p), id(up)))) is not None:
                found = known
                break
            way.append(up)
            up = up.parent
        for n in way:
            self.memo[id(p), id(n)] = found
        return found

    def simple(self, name: str, args: tuple, e: Node) -> bool:
        if name == "tag":
            return e.tag == args[0]
        if name == "all":
            return True
        if name == "tag_ns":
            return e.tag.startswith(args[1]) if args[0] == "prefix" else e.tag == args[1] or e.tag.endswith(":" + args[1])
        if name == "id":
            return e.attr("id") == args[0]
        if name == "class":
            return args[0] in (e.attr("class") or "").lower().split()
        if name == "attr":
            return attribute(e, args[0], self.base) is not None
        if name == "attr_prefix":
            return any(k.lower().startswith(args[0]) for k, _ in e.attrs)
        if name.startswith("attr_"):
            value = attribute(e, args[0], self.base)
            if name == "attr_ne":
                return (value or "").lower() != args[1]
            if value is None:
                return False
            low = value.lower()
            return {
                "attr_eq": lambda: low.strip() == args[1], "attr_start": lambda: low.startswith(args[1]), "attr_end": lambda: low.endswith(args[1]),
                "attr_has": lambda: args[1] in low, "attr_re": lambda: re.search(args[1], value) is not None,
            }[name]()
        if name == "index":
            k = self.place(e)[0]
            return {"eq": k == args[1], "gt": k > args[1], "lt": e is not self.root and k < args[1]}[args[0]]
        if name == "nth":
            last, of_type, step, offset = args
            if e.parent is None or e.parent.kind == "document":
                return False
            k, n, t, m = self.place(e)
            place = (m - t + 1 if last else t) if of_type else (n - k if last else k + 1)
            return nth_matches(step, offset, place)
        if name == "root":
            return e is (next(iter(self.root.elements()), None) if self.root.kind == "document" else self.root)
        if name == "scope":
            return e is self.root
        if name == "empty":
            return all(c.kind in ("comment", "declaration", "doctype") or (c.kind == "text" and T.is_blank(c.value)) for c in e.children)
        if name == "text":
            found = _TEXTS[args[0]](e)
            return args[1] in (found.lower() if args[0] in ("text", "own", "data") else found)
        if name == "text_re":
            return re.search(args[1], _TEXTS[args[0]](e)) is not None
        if name == "match_text":
            return e.pseudo
        raise AssertionError(name)


def wrap_texts(root: Node) -> None:
    """Every text of an element below a root becomes an element of its own, of the same tag and attributes,
    that selectors can find and that is not written."""
    for n in list(root.walk()):
        if n.kind == "element" and not n.pseudo:
            for k, c in enumerate(n.children):
                if c.kind == "text":
                    pseudo = Node("element", n.tag, n.attrs, ns=n.ns, raw_tag=n.raw_tag)
                    pseudo.pseudo, pseudo.parent, pseudo.children, c.parent = True, n, [c], pseudo
                    n.children[k] = pseudo


def select(root: Node, css: str, base: str = "", first: bool = False) -> list[Node]:
    """Elements below and at ``root`` that match, in document order."""
    plan, matcher, out = S.parse(css), Matcher(root, base), []
    if S.asks_for(plan, "match_text"):
        wrap_texts(root)
    for n in root.walk():
        if n.kind == "element" and matcher.test(plan, n):
            out.append(n)
            if first:
                break
    return out
