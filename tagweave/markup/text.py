"""Text of elements, and their markup again."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tagweave.markup import tags as T
from tagweave.markup.tree import Node

TEXT = ("text", "cdata")


def keeps_space(node: Node | None) -> bool:
    for _ in range(6):
        if node is None or node.kind != "element":
            return False
        if node.tag in T.KEEP_SPACE:
            return True
        node = node.parent
    return False


class _Joined:
    """Text put together with single spaces between words of different pieces."""

    def __init__(self):
        self.parts: list[str] = []
        self.last = ""

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.last = s[-1]

    def piece(self, node: Node) -> None:
        if node.kind == "cdata" or keeps_space(node.parent):
            self.add(node.value)
        else:
            s = T.normalise(node.value)
            self.add(s[1:] if self.last == " " and s.startswith(" ") or not self.parts and s.startswith(" ") else s)

    def space(self) -> None:
        if self.parts and self.last != " ":
            self.add(" ")

    def result(self) -> str:
        return "".join(self.parts).strip(T.SPACE)


def is_block(node: Node) -> bool:
    return node.kind == "element" and node.tag in T.BLOCK


def text(node: Node) -> str:
    """Visible text with white space normalised; blocks and line breaks part words."""
    out, todo = _Joined(), [(node, None, False)]
    while todo:
        n, follow, leaving = todo.pop()
        if leaving:
            if is_block(n) and follow is not None and (follow.kind in TEXT or (follow.kind == "element" and follow.tag not in T.BLOCK)):
                out.space()
            continue
        if n.kind in TEXT:
            out.piece(n)
        elif n.kind in ("element", "document"):
            if is_block(n) or n.tag == "br":
                out.space()
            todo.append((n, follow, True))
            todo.extend((c, after, False) for c, after in zip(reversed(n.children), [None, *reversed(n.children)], strict=False))
    return out.result()


def own_text(node: Node) -> str:
    out = _Joined()
    for c in node.children:
        if c.kind in TEXT:
            out.piece(c)
        elif c.tag == "br":
            out.space()
    return out.result()


def whole_text(node: Node) -> str:
    return "".join("\n" if n.tag == "br" else n.value for n in node.walk() if n.kind in TEXT or n.tag == "br")


def whole_own_text(node: Node) -> str:
    return "".join("\n" if n.tag == "br" else n.value for n in node.children if n.kind in TEXT or n.tag == "br")


def data(node: Node) -> str:
    """Contents of scripts, styles and comments below an element."""
    return "".join(n.value for n in node.walk() if n.kind in ("data", "comment", "cdata"))


@dataclass(frozen=True)
class Output:
    """How markup is written: ``pretty`` puts blocks on lines of their own, ``outline`` all elements."""

    pretty: bool = True
    indent: int = 1
    outline: bool = False
    xml: bool = False
    mode: str = "base"
    charset: str = "utf-8"
    most_padding: int = 30


_XML_NAME, _NOT_XML = re.compile(r"[a-zA-Z_:][-a-zA-Z0-9_:.]*"), re.compile(r"[^-a-zA-Z0-9_:.]")
_HTML_NAME, _NOT_HTML = re.compile(r"[^\x00-\x1f\x7f-\x9f \"'/=]+"), re.compile(r"[\x00-\x1f\x7f-\x9f \"'/=]")


def attribute_name(name: str, xml: bool) -> str | None:
    """A name that can be written: signs that can't become underscores; ``None`` if no name comes of it."""
    fits, wrong = (_XML_NAME, _NOT_XML) if xml else (_HTML_NAME, _NOT_HTML)
    name = name if fits.fullmatch(name) else wrong.sub("_", name)
    return name if fits.fullmatch(name) else None


def _attributes(node: Node, out: Output) -> str:
    parts = []
    for k, v in node.attrs:
        name = attribute_name(k, out.xml)
        if name is None:
            continue
        if not out.xml and (v is None or (v == "" or v.lower() == k.lower()) and k.lower() in T.BOOLEAN_ATTRS):
            parts.append(f" {name}")
        else:
            parts.append(f' {name}="{T.escape(v or "", out.mode, True, out.charset)}"')
    return "".join(parts)


def _as_block(node: Node | None) -> bool:
    """Whether children of an element of this tag are laid out as blocks."""
    return node is not None and node.kind in ("element", "document") and node.tag not in T.INLINE and node.tag not in T.FORMAT_INLINE


def _blank(node: Node | None) -> bool:
    return node is not None and node.kind == "text" and T.is_blank(node.value)


class _Writer:
    """Writes nodes one after the other; no recursion, documents may be deep."""

    def __init__(self, out: Output):
        self.out, self.parts = out, []

    def line(self, depth: int) -> None:
        self.parts.append("\n" + " " * min(depth * self.out.indent, self.out.most_padding if self.out.most_padding >= 0 else 1 << 30))

    def leads(self, n: Node, at: int) -> bool:
        """Whether nothing but blank text stands before it."""
        return at == 0 or (at == 1 and _blank(n.parent.children[0]))

    def indents(self, n: Node, at: int) -> bool:
        if not self.out.pretty or n.kind != "element":
            return False
        inline = n.tag not in T.BLOCK
        if inline and not (_as_block(n.parent) or self.out.outline):
            return False
        flows = inline and (n.parent is None or is_block(n.parent)) and not self.leads(n, at) and not self.out.outline and n.tag != "br"
        return not flows and not keeps_space(n.parent)

    def text(self, n: Node, at: int, depth: int) -> None:
        value, siblings = n.value, n.parent.children if n.parent is not None else [n]
        if self.out.pretty and not keeps_space(n.parent):
            before, after = siblings[at - 1] if at else None, siblings[at + 1] if at + 1 < len(siblings) else None
            blank, parent = T.is_blank(value), n.parent if n.parent is not None and n.parent.kind in ("element", "document") else None
            broken = before is not None and (is_block(before) or before.tag == "br")
            if blank and (broken or _blank(after) or after is not None and self.indents(after, at + 1)):
                return
            if not blank and (before is None and _as_block(parent) or self.out.outline and len(siblings) > 1) or before is not None and before.tag == "br":
                self.line(depth)
            value = T.normalise(value)
            trims = parent is not None and (is_block(parent) or _as_block(parent))
            if trims and at == 0 or parent is not None and parent.kind == "document":
                value = value.lstrip(" ")
            if trims and after is None:
                value = value.rstrip(" ")
        self.parts.append(T.escape(value, self.out.mode, False, self.out.charset))

    def open(self, n: Node, at: int, depth: int) -> None:
        out = self.out
        if self.indents(n, at) and self.parts:
            self.line(depth)
        close = ">"
        if not n.children and self.alone(n) and (out.xml or n.tag not in T.VOID):
            close = " />"
        self.parts.append(f"<{n.raw_tag}{_attributes(n, out)}{close}")

    @staticmethod
    def alone(n: Node) -> bool:
        return n.closed or n.tag in T.VOID and n.ns == "html"

    def close(self, n: Node, depth: int) -> None:
        if not n.children and self.alone(n):
            return
        laid = self.out.pretty and n.children and (_as_block(n) and not keeps_space(n.parent) or self.out.outline and (len(n.children) > 1 or n.children[0].kind == "element"))
        if laid:
            self.line(depth)
        self.parts.append(f"</{n.raw_tag}>")

    def leaf(self, n: Node, at: int, depth: int) -> None:
        out = self.out
        if n.kind == "cdata":
            self.parts.append(f"<![CDATA[{n.value}]]>")
        elif n.kind == "data":
            if not out.xml or "<![CDATA[" in n.value:
                self.parts.append(n.value)
            else:
                lead, tail = {"script": ("//", "\n//"), "style": ("/*", "\n/*")}.get(n.parent.tag if n.parent is not None else "", ("", ""))
                end = "*/" if lead == "/*" else ""
                self.parts.append(f"{lead}<![CDATA[{end}{chr(10) if lead else ''}{n.value}{tail}]]>{end}")
        elif n.kind == "comment":
            if out.pretty and (n.parent is not None and n.parent.kind == "element" and self.leads(n, at) and _as_block(n.parent) or out.outline):
                self.line(depth)
            self.parts.append(f"<!--{n.value}-->")
        elif n.kind == "declaration":
            self.parts.append(f"<{n.tag[0] if n.tag[0] == '!' else '?'}{n.value}{'' if n.tag[0] == '!' else '?'}>")
        elif n.kind == "doctype":
            ids = dict(n.attrs)
            if at > 0 and out.pretty:
                self.parts.append("\n")
            known = ids.get("publicId") or ids.get("systemId")
            quoted = "".join(f' "{ids[i]}"' for i in ("publicId", "systemId") if ids.get(i))
            self.parts.append(f"{'<!DOCTYPE' if known or out.xml else '<!doctype'}{' ' + ids['name'] if ids.get('name') else ''}{' ' + ids['pubSysKey'] if ids.get('pubSysKey') else ''}{quoted}>")

    def write(self, nodes: list[Node]) -> str:
        todo = [(n, n.index() if n.parent is not None else 0, 0, False) for n in reversed(nodes)]
        while todo:
            n, at, depth, leaving = todo.pop()
            if leaving:
                self.close(n, depth)
            elif n.kind == "text":
                self.text(n, at, depth)
            elif n.kind == "document":
                todo.extend((c, k, depth, False) for k, c in reversed(list(enumerate(n.children))))
            elif n.pseudo:
                todo.extend((c, k, depth, False) for k, c in reversed(list(enumerate(n.children))))
            elif n.kind == "element":
                self.open(n, at, depth)
                todo.append((n, at, depth, True))
                todo.extend((c, k, depth + 1, False) for k, c in reversed(list(enumerate(n.children))))
            else:
                self.leaf(n, at, depth)
        return "".join(self.parts)


def markup(node: Node, out: Output) -> str:
    """Markup of a node."""
    return _Writer(out).write([node])


def inner_markup(node: Node, out: Output) -> str:
    """Markup of what is inside a node."""
    found = "".join(_Writer(out).write([c]) for c in node.children)
    return found.strip("".join(map(chr, range(33)))) if out.pretty else found


def outer_html(node: Node, xml: bool = False, mode: str = "base", charset: str = "utf-8") -> str:
    """Markup of a node as it stands, not indented."""
    return markup(node, Output(False, xml=xml, mode=mode, charset=charset))


def inner_html(node: Node, xml: bool = False, mode: str = "base", charset: str = "utf-8") -> str:
    return inner_markup(node, Output(False, xml=xml, mode=mode, charset=charset))


def pretty_html(node: Node, indent: int = 1, outline: bool = False) -> str:
    """Markup with blocks on lines of their own, indented by depth; text inside blocks normalised."""
    out = Output(True, indent, outline)
    return inner_markup(node, out) if node.kind == "document" else markup(node, out)
