"""Sanitising: what of a document's body may stay."""

from __future__ import annotations

import copy
import re
from collections import defaultdict
from dataclasses import dataclass, field

from tagweave.markup import text as X
from tagweave.markup.tree import Document, Node, parse_body_fragment, shell
from tagweave.markup.urls import resolve

_ANCHOR = re.compile(r"#\S*$")


@dataclass
class Safelist:
    """Allowed tags, attributes by tag (":all" for any), attributes with a forced value, protocols by attribute."""

    tags: set[str] = field(default_factory=set)
    attributes: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    enforced: dict[str, dict[str, str]] = field(default_factory=lambda: defaultdict(dict))
    protocols: dict[tuple[str, str], set[str]] = field(default_factory=lambda: defaultdict(set))
    relative_links: bool = False

    def add_tags(self, *tags: str) -> Safelist:
        for t in map(str.lower, tags):
            if t == "noscript":
                raise ValueError("noscript can't be made safe")
            self.tags.add(t)
        return self

    def remove_tags(self, *tags: str) -> Safelist:
        for t in map(str.lower, tags):
            self.tags.discard(t)
            self.attributes.pop(t, None)
            self.enforced.pop(t, None)
            for key in [k for k in self.protocols if k[0] == t]:
                del self.protocols[key]
        return self

    def add_attributes(self, tag: str, *names: str) -> Safelist:
        if tag != ":all":
            self.add_tags(tag)
        self.attributes[tag.lower()].update(map(str.lower, names))
        return self

    def remove_attributes(self, tag: str, *names: str) -> Safelist:
        for t in list(self.attributes) if tag == ":all" else [tag.lower()]:
            self.attributes[t] -= set(map(str.lower, names))
        return self

    def add_enforced(self, tag: str, name: str, value: str) -> Safelist:
        self.add_tags(tag)
        self.enforced[tag.lower()][name.lower()] = value
        return self

    def remove_enforced(self, tag: str, name: str) -> Safelist:
        self.enforced[tag.lower()].pop(name.lower(), None)
        return self

    def add_protocols(self, tag: str, name: str, *protocols: str) -> Safelist:
        self.protocols[tag.lower(), name.lower()].update(map(str.lower, protocols))
        return self

    def remove_protocols(self, tag: str, name: str, *protocols: str) -> Safelist:
        key = (tag.lower(), name.lower())
        if key not in self.protocols:
            raise ValueError(f"no protocols for {key}")
        self.protocols[key] -= set(map(str.lower, protocols))
        if not self.protocols[key]:
            del self.protocols[key]
        return self

    def preserve_relative_links(self, keep: bool = True) -> Safelist:
        self.relative_links = keep
        return self

    def safe_value(self, tag: str, name: str, value: str, base: str) -> str | None:
        """The value that an attribute may keep, made absolute where its protocol is tested; ``None`` if it must go."""
        if name in self.attributes.get(tag, ()):
            allowed = self.protocols.get((tag, name))
            if not allowed:
                return value
            url = resolve(base, value) or value
            kept = value if self.relative_links else url
            for p in allowed:
                if p == "#":
                    if _ANCHOR.match(value):
                        return kept
                elif url.lower().startswith(p + ":"):
                    return kept
            return None
        forced = self.enforced.get(tag, {})
        if name in forced:
            return value if forced[name] == value else None
        return self.safe_value(":all", name, value, base) if tag != ":all" else None


def none() -> Safelist:
    return Safelist()


# The tags, attributes and protocols of the presets.
def simple_text() -> Safelist:
    return Safelist().add_tags("b", "em", "i", "strong", "u")


def basic() -> Safelist:
    s = Safelist().add_tags(*"a b blockquote br cite code dd dl dt em i li ol p pre q small span strike strong sub sup u ul".split())
    s.add_attributes("a", "href").add_attributes("blockquote", "cite").add_attributes("q", "cite")
    s.add_protocols("a", "href", "ftp", "http", "https", "mailto").add_protocols("blockquote", "cite", "http", "https").add_protocols("cite", "cite", "http", "https")
    return s.add_enforced("a", "rel", "nofollow")


def basic_with_images() -> Safelist:
    return basic().add_attributes("img", "align", "alt", "height", "src", "title", "width").add_protocols("img", "src", "http", "https")


def relaxed() -> Safelist:
    s = Safelist().add_tags(
        *"a b blockquote br caption cite code col colgroup dd div dl dt em h1 h2 h3 h4 h5 h6 i img li ol p pre q small span strike strong sub sup "
        "table tbody td tfoot th thead tr u ul".split()
    )
    for tag, names in {
        "a": "href title", "blockquote": "cite", "col": "span width", "colgroup": "span width", "img": "align alt height src title width", "ol": "start type", "q": "cite",
        "table": "summary width", "td": "abbr axis colspan rowspan width", "th": "abbr axis colspan rowspan scope width", "ul": "type",
    }.items():
        s.add_attributes(tag, *names.split())
    s.add_protocols("a", "href", "ftp", "http", "https", "mailto")
    for tag, name in (("blockquote", "cite"), ("cite", "cite"), ("img", "src"), ("q", "cite")):
        s.add_protocols(tag, name, "http", "https")
    return s


PRESETS = {"none": none, "simple_text": simple_text, "basic": basic, "basic_with_images": basic_with_images, "relaxed": relaxed}


def clean_document(doc: Document, safe: Safelist) -> tuple[Document, int]:
    """(a document of what is safe in the body, number of elements and attributes that were not)."""
    out, dropped = shell(doc.base_uri), 0
    body = _body(out)
    source = next((e for e in doc.walk() if e.kind == "element" and e.tag == "body"), None)
    todo = [(c, body) for c in reversed(source.children)] if source is not None else []
    while todo:
        node, dest = todo.pop()
        if node.kind == "element":
            if node.tag in safe.tags:
                new = dest.append(Node("element", node.tag, ns=node.ns, raw_tag=node.raw_tag))
                for name, value in node.attrs:
                    kept = safe.safe_value(node.tag, name.lower(), value or "", doc.base_uri)
                    if kept is None:
                        dropped += 1
                    else:
                        new.attrs.append((name, None if value is None else kept))
                for name, value in safe.enforced.get(node.tag, {}).items():
                    new.attrs = [(k, v) for k, v in new.attrs if k.lower() != name] + [(name, value)]
                dest = new
            else:
                dropped += 1
            todo.extend((c, dest) for c in reversed(node.children))
        elif node.kind == "text":
            dest.append(Node("text", "#text", value=node.value))
        elif node.kind == "data" and node.parent is not None and node.parent.tag in safe.tags:
            dest.append(Node("data", "#data", value=node.value))
        else:
            dropped += 1
    return out, dropped


def _body(doc: Document) -> Node:
    return doc.children[0].children[1]


def clean(html: str, safe: Safelist, base_uri: str = "") -> str:
    """Safe HTML of a body fragment."""
    return X.inner_html(_body(clean_document(parse_body_fragment(html, base_uri), safe)[0]))


def is_valid(html: str, safe: Safelist) -> bool:
    """Whether nothing of a body fragment would be dropped and its markup has no errors."""
    errors: list = []
    doc = parse_body_fragment(html, errors=errors)
    return not errors and not clean_document(doc, safe)[1]


def is_valid_document(doc: Document, safe: Safelist) -> bool:
    """Whether nothing of a document's body would be dropped and its head is empty."""
    head = next((e for e in doc.walk() if e.kind == "element" and e.tag == "head"), None)
    return not clean_document(doc, safe)[1] and (head is None or not head.children)


def copy_of(safe: Safelist) -> Safelist:
    return copy.deepcopy(safe)
