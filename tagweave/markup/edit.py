"""Changes to a document's tree. Each takes the element and what is put there as HTML."""

from __future__ import annotations

import re
from collections.abc import Callable

from tagweave.markup.tree import Document, Node, parse_fragment


def _fragment(e: Node, html: str, inside: bool) -> list[Node]:
    context = e if inside else e.parent
    return parse_fragment(html, context.tag if context is not None and context.kind == "element" else "body")


def _insert(parent: Node, at: int, nodes: list[Node]) -> None:
    for k, n in enumerate(nodes):
        parent.append(n, at + k)


def before(e: Node, html: str) -> None:
    _insert(e.parent, e.index(), _fragment(e, html, False))


def after(e: Node, html: str) -> None:
    _insert(e.parent, e.index() + 1, _fragment(e, html, False))


def append(e: Node, html: str) -> None:
    _insert(e, len(e.children), _fragment(e, html, True))


def prepend(e: Node, html: str) -> None:
    _insert(e, 0, _fragment(e, html, True))


def inner(e: Node, html: str) -> None:
    empty(e)
    append(e, html)


def empty(e: Node, _: str = "") -> None:
    for c in list(e.children):
        c.parent = None
    e.children = []


def remove(e: Node, _: str = "") -> None:
    e.remove()


def unwrap(e: Node, _: str = "") -> None:
    parent, at = e.parent, e.index()
    kept, e.children = e.children, []
    e.remove()
    for c in kept:
        c.parent = None
    _insert(parent, at, kept)


def wrap(e: Node, html: str) -> None:
    """Into the deepest first element of the wrapper; what else it has stands after the element."""
    nodes = _fragment(e, html, False)
    top = next((n for n in nodes if n.kind == "element"), None)
    if top is None:
        return
    parent, at = e.parent, e.index()
    e.remove()
    _insert(parent, at, [n for n in nodes if n is top])
    deep = top
    while deep.elements():
        deep = deep.elements()[0]
    deep.append(e)
    for n in nodes:
        if n is not top:
            deep.append(n)


def replace_with(e: Node, html: str) -> None:
    parent, at, nodes = e.parent, e.index(), _fragment(e, html, False)
    e.remove()
    _insert(parent, at, nodes)


def set_text(e: Node, value: str) -> None:
    empty(e)
    e.append(Node("text", "#text", value=value))


def append_text(e: Node, value: str) -> None:
    e.append(Node("text", "#text", value=value))


def prepend_text(e: Node, value: str) -> None:
    e.append(Node("text", "#text", value=value), 0)


def rename(e: Node, tag: str) -> None:
    e.tag, e.raw_tag = tag.lower(), tag


def set_attr(e: Node, pair: str) -> None:
    """``name=value``."""
    name, _, value = pair.partition("=")
    at = next((k for k, (n, _) in enumerate(e.attrs) if n.lower() == name.lower()), None)
    if at is None:
        e.attrs.append((name, value))
    else:
        e.attrs[at] = (e.attrs[at][0], value)


def remove_attr(e: Node, name: str) -> None:
    e.attrs = [(k, v) for k, v in e.attrs if k.lower() != name.lower()]


def _classes(e: Node, change: Callable[[list[str]], list[str]]) -> None:
    names = change(list(dict.fromkeys((e.attr("class") or "").split())))
    set_attr(e, "class=" + " ".join(names)) if names else remove_attr(e, "class")


def add_class(e: Node, name: str) -> None:
    _classes(e, lambda c: c if name in c else [*c, name])


def remove_class(e: Node, name: str) -> None:
    _classes(e, lambda c: [x for x in c if x != name])


def toggle_class(e: Node, name: str) -> None:
    _classes(e, lambda c: [x for x in c if x != name] if name in c else [*c, name])


def append_element(e: Node, tag: str) -> None:
    e.append(Node("element", tag.lower(), raw_tag=tag))


def prepend_element(e: Node, tag: str) -> None:
    e.append(Node("element", tag.lower(), raw_tag=tag), 0)


def clear_attrs(e: Node, _: str = "") -> None:
    e.attrs = []


def set_value(e: Node, value: str) -> None:
    """What a form control holds: the text of a ``textarea``, else the attribute ``value``."""
    set_text(e, value) if e.tag == "textarea" else set_attr(e, f"value={value}")


def set_data(e: Node, data: str) -> None:
    """The contents of a script, style or comment."""
    if e.kind != "element":
        e.value = data
    else:
        empty(e)
        e.append(Node("data", "#data", value=data))


def split_text(e: Node, at: str) -> None:
    """The first text of an element (or a text) becomes two, before a place."""
    n = e if e.kind == "text" else next((c for c in e.children if c.kind == "text"), None)
    if n is None or not 0 <= int(at) <= len(n.value):
        raise ValueError(f"no text to split at {at}")
    rest = Node("text", "#text", value=n.value[int(at) :])
    n.value = n.value[: int(at)]
    if n.parent is not None:
        n.parent.append(rest, n.index() + 1)


def insert_children(e: Node, at: int, nodes: list[Node]) -> None:
    """Nodes before the child at a place; a negative place counts from behind the last."""
    at = at if at >= 0 else len(e.children) + 1 + at
    if not 0 <= at <= len(e.children):
        raise IndexError(f"{at} is no place among {len(e.children)} children")
    _insert(e, at, nodes)


def remove_range(e: Node, start: int, end: int) -> None:
    """The children from one place up to another go."""
    for c in e.children[start:end]:
        c.parent = None
    del e.children[start:end]


def append_to(e: Node, parent: Node) -> None:
    parent.append(e)


def has_parent(e: Node) -> bool:
    return e.parent is not None


def has_attributes(e: Node) -> bool:
    return bool(e.attrs)


def as_declaration(comment: Node) -> Node | None:
    """The declaration that a comment holds in its place, as ``<?xml version="1.0"?>`` read as HTML has become; else ``None``."""
    data = comment.value
    if comment.kind != "comment" or len(data) < 2 or data[0] not in "!?" or data[1] in "!?":
        return None
    body = data[1:].removesuffix("?")
    new = Node("declaration", f"{data[0]}declaration" if data[0] == "!" else "#declaration", value=body, ns="xml")
    if comment.parent is not None:
        parent, at = comment.parent, comment.index()
        comment.remove()
        parent.append(new, at)
    return new


def set_title(doc: Node, title: str) -> None:
    head = next(n for n in doc.walk() if n.tag == "head")
    found = next((n for n in head.walk() if n.tag == "title"), None) or head.append(Node("element", "title"))
    set_text(found, title)


def set_charset(doc: Document, charset: str) -> None:
    """The declared character set: ``meta charset`` of the head, which other metas of that kind give way to, or the XML declaration."""
    if doc.xml:
        first = next((c for c in doc.children if c.kind == "declaration"), None)
        value = re.sub(r'encoding="[^"]*"', f'encoding="{charset}"', first.value) if first is not None and "encoding" in first.value else f'xml version="1.0" encoding="{charset}"'
        if first is not None:
            first.value = value
        else:
            doc.append(Node("declaration", "#declaration", value=value, ns="xml"), 0)
        return
    every = list(doc.walk())
    own = next((n for n in every if n.tag == "meta" and n.attr("charset") is not None), None)
    if own is None:
        own = next(n for n in every if n.tag == "head").append(Node("element", "meta"))
    set_attr(own, f"charset={charset}")
    for n in every:
        if n.tag == "meta" and (n.attr("name") or "").lower() == "charset":
            n.remove()


OPERATIONS: dict[str, Callable[[Node, str], None]] = {
    f.__name__: f
    for f in (before, after, append, prepend, inner, empty, remove, unwrap, wrap, replace_with, set_text, append_text, prepend_text, rename, set_attr, remove_attr, add_class, remove_class, toggle_class, append_element, prepend_element, clear_attrs, set_value, set_data, split_text)
}
