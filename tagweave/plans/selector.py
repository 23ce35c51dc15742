"""The selector language: from a CSS string to a tree of predicates and combinators.

The tree is plain data. ``tagweave.markup.match`` runs it on one document, ``tagweave.operators.select``
compiles it to predicates and joins over the relation of nodes; both give the same answers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class SelectorError(ValueError):
    """The selector can't be parsed."""


@dataclass(frozen=True)
class Test:
    """A predicate on one element: ``name`` with its arguments."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Related:
    """What stands left of a combinator: ``how`` is ancestor, parent, before or previous."""

    how: str
    left: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Is:
    inner: object


@dataclass(frozen=True)
class Has:
    inner: object
    sibling: bool = False  # led by + or ~: siblings are tried as well


# The order in which parts of a conjunction are tried, which printed plans show.
COSTS = {
    "tag": 1, "tag_ns": 1, "id": 2, "attr": 2, "attr_prefix": 6, "attr_eq": 3, "attr_ne": 3, "attr_start": 4, "attr_end": 4, "attr_has": 6, "attr_re": 8, "class": 6,
    "all": 10, "index": 2, "nth": 6, "root": 1, "scope": 1, "empty": 6, "text": 10, "text_re": 8, "match_text": -1,
}
_COMBINATORS = {" ": "ancestor", ">": "parent", "~": "before", "+": "previous"}
_LEFT_COST = {"ancestor": 8, "parent": 2, "before": 6, "previous": 2}


def cost(node) -> int:
    """How dear a predicate is to test; the parts of a conjunction are tested cheapest first."""
    if isinstance(node, Test):
        return COSTS[node.name]
    if isinstance(node, All | Any):
        return sum(map(cost, node.parts))
    if isinstance(node, Related):
        return _LEFT_COST[node.how] * cost(node.left)
    return (10 if isinstance(node, Has) else 2) * cost(node.inner)


def both(*parts):
    flat = [q for p in parts for q in (p.parts if isinstance(p, All) else (p,))]
    return flat[0] if len(flat) == 1 else All(tuple(sorted(flat, key=cost)))


def asks_for(plan, name: str) -> bool:
    """Whether a test is somewhere in a plan."""
    if isinstance(plan, Test):
        return plan.name == name
    if isinstance(plan, All | Any):
        return any(asks_for(p, name) for p in plan.parts)
    return asks_for(plan.left if isinstance(plan, Related) else plan.inner, name)


def is_free(plan) -> bool:
    """Whether a plan's answer doesn't depend on the element that it is tried below."""
    if isinstance(plan, Test):
        return plan.name not in ("root", "scope") and (plan.name, plan.args[:1]) != ("index", ("lt",))
    if isinstance(plan, All | Any):
        return all(map(is_free, plan.parts))
    return is_free(plan.inner) if isinstance(plan, Not | Is) else isinstance(plan, Has)


def one_relation(inner) -> tuple[str, object] | None:
    """(how, plan) if a plan inside ``:has`` asks for one relation to the element and nothing else of it."""
    parts = inner.parts if isinstance(inner, All) else (inner,)
    tied = [p for p in parts if isinstance(p, Related) and p.left == Test("scope")]
    rest = tuple(p for p in parts if p not in tied)
    if len(tied) > 1 or not rest or not all(map(is_free, rest)):
        return None
    return (tied[0].how if tied else "ancestor"), (rest[0] if len(rest) == 1 else All(rest))


def to_sexpr(node) -> str:
    """The plan in prefix form."""
    if isinstance(node, Test):
        return f"({node.name}{''.join(f' {a!r}' for a in node.args)})"
    if isinstance(node, All | Any):
        return f"({'and' if isinstance(node, All) else 'or'} {' '.join(map(to_sexpr, node.parts))})"
    if isinstance(node, Related):
        return f"({node.how} {to_sexpr(node.left)})"
    return f"({type(node).__name__.lower()} {to_sexpr(node.inner)})"


_IDENT = re.compile(r"(?:[A-Za-z0-9_\-]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}\s?|.))+", re.S)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)
_ATTR_OPS = ("!=", "^=", "$=", "*=", "~=", "=")
_NTH = re.compile(r"^(([+-])?(\d+)?)n(\s*([+-])?\s*\d+)?$", re.I)


def _plain(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2], s)


def _unquoted(s: str) -> str:
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s


def compile_regex(source: str) -> str:
    try:
        re.compile(source)
    except re.error as e:
        raise SelectorError(f"pattern {source!r}: {e}") from e
    return source


class _Parser:
    def __init__(self, css: str):
        self.css, self.s, self.at = css, css.strip(), 0

    def fail(self, why: str):
        raise SelectorError(f"could not parse selector {self.css!r}: {why} at {self.s[self.at :]!r}")

    def peek(self, text: str) -> bool:
        return self.s.startswith(text, self.at)

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.at += len(text)
            return True
        return False

    def blanks(self) -> bool:
        start = self.at
        while self.at < len(self.s) and self.s[self.at].isspace():
            self.at += 1
        return self.at > start

    def ident(self) -> str:
        m = _IDENT.match(self.s, self.at)
        if not m:
            self.fail("a name is missing")
        self.at = m.end()
        return _plain(m[0])

    def balanced(self, close: str) -> str:
        """Up to the bracket that closes the one before, quotes and inner brackets aside."""
        open_, depth, start, quote = self.s[self.at - 1], 1, self.at, ""
        while self.at < len(self.s):
            c = self.s[self.at]
            self.at += 1
            if c == "\\":
                self.at += 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == open_:
                depth += 1
            elif c == close:
                depth -= 1
                if not depth:
                    return self.s[start : self.at - 1]
        self.fail(f"{close!r} is missing")

    def group(self, relative: bool = False):
        branches = []
        while True:
            branches.append(self.chain(relative))
            self.blanks()
            if not self.take(","):
                break
            self.blanks()
            if self.at >= len(self.s):
                self.fail("a selector is missing")
        if self.at < len(self.s):
            self.fail("unexpected token")
        return branches[0] if len(branches) == 1 else Any(tuple(branches))

    def chain(self, relative: bool):
        self.blanks()
        left = None
        if self.at < len(self.s) and self.s[self.at] in ">+~":
            left = Test("scope")
        else:
            left = self.compound()
        while True:
            space = self.blanks()
            if self.at >= len(self.s) or self.peek(","):
                return left
            sign = self.s[self.at]
            if sign in ">+~":
                self.at += 1
                self.blanks()
            elif space:
                sign = " "
            else:
                self.fail("unexpected token")
            left = both(self.compound(), Related(_COMBINATORS[sign], left))

    def compound(self):
        parts = []
        while self.at < len(self.s) and not self.s[self.at].isspace() and self.s[self.at] not in ",>+~":
            parts.append(self.simple())
        if not parts:
            self.fail("a selector is missing")
        return both(*parts)

    def simple(self):
        if self.take("#"):
            return Test("id", (self.ident(),))
        if self.take("."):
            return Test("class", (self.ident().strip().lower(),))
        if self.take("["):
            return self.attribute(self.balanced("]"))
        if self.take("::") or self.take(":"):
            return self.pseudo()
        if self.take("*|"):
            return Test("tag_ns", ("any", self.ident().lower()))
        if self.take("*"):
            return Test("all")
        name = self.ident().lower()
        if self.take("|"):
            if self.take("*"):
                return Test("tag_ns", ("prefix", name + ":"))
            return Test("tag", (f"{name}:{self.ident().lower()}",))
        return Test("tag", (name,))

    def attribute(self, body: str):
        body = body.strip()
        m = re.match(r"[^=!^$*~\s]+", body)
        if body.startswith("^") and "=" not in body:
            return Test("attr_prefix", (body[1:].strip().lower(),))
        if body == "*":
            return Test("attr_prefix", ("",))
        if not m:
            self.fail("an attribute name is missing")
        key, rest = m[0].lower(), body[m.end() :].strip()
        if not rest:
            return Test("attr", (key,))
        op = next((o for o in _ATTR_OPS if rest.startswith(o)), None)
        if op is None:
            self.fail(f"could not parse attribute {body!r}")
        raw = rest[len(op) :].strip()
        if op == "~=":
            return Test("attr_re", (key, compile_regex(_unquoted(raw))))
        value = _unquoted(raw).lower()
        if op in ("=", "!=", "*="):
            value = value.strip()
        if not raw:
            self.fail("an attribute value is missing")
        return Test({"=": "attr_eq", "!=": "attr_ne", "^=": "attr_start", "$=": "attr_end", "*=": "attr_has"}[op], (key, value))

    def argument(self) -> str:
        if not self.take("("):
            self.fail("'(' is missing")
        body = self.balanced(")")
        if not body.strip():
            self.fail("an argument is missing")
        return body

    def pseudo(self):
        name = self.ident().lower()
        if name in ("has", "is", "where", "not"):
            inner = _Parser(self.argument())
            tree = inner.group(relative=name == "has")
            if name == "has":
                return Has(tree, inner.s.lstrip()[:1] in "+~")
            return Not(tree) if name == "not" else Is(tree)
        if name in ("eq", "lt", "gt"):
            arg = self.argument().strip()
            if not re.fullmatch(r"[+-]?\d+", arg):
                self.fail("index must be numeric")
            return Test("index", (name, int(arg)))
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            return Test("nth", ("last" in name, "type" in name, *self.nth(self.argument())))
        if name in ("first-child", "last-child", "first-of-type", "last-of-type"):
            return Test("nth", ("last" in name, "type" in name, 0, 1))
        if name in ("only-child", "only-of-type"):
            kind = "type" in name
            return both(Test("nth", (False, kind, 0, 1)), Test("nth", (True, kind, 0, 1)))
        if name == "empty":
            return Test("empty")
        if name == "root":
            return Test("root")
        if name == "matchtext":
            return Test("match_text")
        kinds = {"contains": "text", "containsown": "own", "containswholetext": "whole", "containswholeowntext": "whole_own", "containsdata": "data"}
        if name in kinds:
            needle = _ESCAPE.sub(lambda m: m[2] or chr(int(m[1], 16)), _unquoted(self.argument()))
            if kinds[name] in ("text", "own"):
                from tagweave.markup.tags import normalise

                needle = normalise(needle).lower()
            return Test("text", (kinds[name], needle.lower() if kinds[name] == "data" else needle))
        kinds = {"matches": "text", "matchesown": "own", "matcheswholetext": "whole", "matcheswholeowntext": "whole_own"}
        if name in kinds:
            return Test("text_re", (kinds[name], compile_regex(_unquoted(self.argument()))))
        self.fail(f"unknown pseudo selector {name!r}")

    def nth(self, arg: str) -> tuple[int, int]:
        """(step, offset). A step without digits is +1 whatever its sign: -n+3 means n+3."""
        arg = arg.strip().lower()
        if arg in ("odd", "even"):
            return (2, 1) if arg == "odd" else (2, 0)
        if m := _NTH.match(arg):
            step = int(m[1].lstrip("+")) if m[3] else 1
            offset = m[4] or ""
            if offset.strip() != offset or re.search(r"[+-]\s", offset):
                self.fail("could not parse nth-index")
            return step, int(offset.lstrip("+")) if offset else 0
        if re.fullmatch(r"[+-]?\d+", arg):
            return 0, int(arg.lstrip("+"))
        self.fail(f"could not parse nth-index {arg!r}")


def parse(css: str):
    """The plan of a selector; ``SelectorError`` if it isn't one."""
    parser = _Parser(css or "")
    if not parser.s:
        parser.fail("it is empty")
    return parser.group()
