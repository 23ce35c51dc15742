"""Operators on whole pages, in one pass each: selections, clean and changed markup, metadata, forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import strings as N
from tagweave.markup import edit as E
from tagweave.markup import match, safelist, scripts
from tagweave.markup import text as X
from tagweave.markup.stream import StreamParser
from tagweave.markup.tags import FORM_LISTED, FORM_SUBMIT
from tagweave.markup.traverse import Outcome, filter_nodes, traverse
from tagweave.markup.tree import Node
from tagweave.operators import select as R
from tagweave.operators import text as RT
from tagweave.operators.parse import document, per_page
from tagweave.plans import selector

FOUND = pa.schema([("page_id", pa.int64()), ("base_uri", pa.string()), ("ord", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("own_text", pa.string()), ("attrs", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("html", pa.string())])


def select_pages(pages: DataFrame, css: str, mode: str = "html", first: bool = False, expected: bool = False) -> DataFrame:
    """Matches of a selector with text and markup, parsed and selected in one pass; nothing else is kept.
    With ``expected`` a page without a match fails the query."""
    selector.parse(css)  # errors show in the driver

    def work(k, h, u):
        doc = document(h, u, mode)
        found = match.select(doc, css, doc.base_uri, first)
        if expected and not found:
            raise LookupError(f"no match of {css!r} in page {k}")
        return [(k, doc.base_uri, i, e.tag, X.text(e), X.own_text(e), [{"name": n, "value": v} for n, v in e.attrs], X.outer_html(e, mode == "xml")) for i, e in enumerate(found)]

    return per_page(pages, work, FOUND)


COUNTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("n", pa.int64())])


def counts_of(pages: DataFrame, css: str, mode: str = "html") -> DataFrame:
    """How many elements of each page match, with the page's address; nothing else is kept."""
    selector.parse(css)

    def work(k, h, u):
        doc = document(h, u, mode)
        return [(k, u, len(match.select(doc, css, doc.base_uri)))]

    return per_page(pages, work, COUNTS)


def completed(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements below and at a node in order of completion, with whether an element follows among siblings."""
    todo = [(root, False, False)]
    while todo:
        n, more, leaving = todo.pop()
        if leaving:
            yield n, more
        elif n.kind in ("element", "document"):
            todo.append((n, more, True))
            later = False
            for c in reversed(n.children):
                if c.kind == "element":
                    todo.append((c, later, False))
                    later = True


STREAMED = pa.schema([("page_id", pa.int64()), ("emit_ord", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("text", pa.string()), ("has_next", pa.bool_())])


def stream_elements(pages: DataFrame, mode: str = "html") -> DataFrame:
    """Every element in order of completion: an element is complete when its next sibling opens or its parent ends."""

    def work(k, h, u):
        return [(k, i, n.tag, n.attr("id"), X.own_text(n), more) for i, (n, more) in enumerate(completed(document(h, u, mode)))]

    return per_page(pages, work, STREAMED)


def select_by(pages: DataFrame, test: Callable[[Node], bool], mode: str = "html") -> DataFrame:
    """As ``select_pages`` by a Python function on elements, for what no selector says."""

    def work(k, h, u):
        doc = document(h, u, mode)
        found = [e for e in doc.walk() if e.kind == "element" and test(e)]
        return [(k, doc.base_uri, i, e.tag, X.text(e), X.own_text(e), [{"name": n, "value": v} for n, v in e.attrs], X.outer_html(e, mode == "xml")) for i, e in enumerate(found)]

    return per_page(pages, work, FOUND)


MATCHED = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("html", pa.string()), ("read", pa.int32())])


def select_streaming(pages: DataFrame, css: str, most: int | None = 1, mode: str = "html") -> DataFrame:
    """Matches in order of completion, as they come: no page is read further than to its ``most``-th match
    (to its end for ``None``). ``read`` tells how much of the markup had been read."""
    plan = selector.parse(css)

    def work(k, h, u):
        n = 0
        with StreamParser(h, u, mode) as stream:
            for e in stream:
                if stream._matches(plan, e):
                    yield k, n, e.tag, X.text(e), X.outer_html(e, mode == "xml"), stream.read
                    n += 1
                    if n == most:
                        break

    return per_page(pages, work, MATCHED)


HTML = pa.schema([("page_id", pa.int64()), ("html", pa.string())])


def serialise(pages: DataFrame, pretty: bool = False, indent: int = 1, xml: bool = False, mode: str = "base", charset: str = "utf-8", outline: bool = False, most_padding: int = 30) -> DataFrame:
    """Markup of the parsed pages: as it stands or indented."""
    out = X.Output(pretty, indent, outline, xml, mode, charset, most_padding)

    def work(k, h, u):
        doc = document(h, u, "xml" if xml else "html")
        return [(k, X.inner_markup(doc, out))]

    return per_page(pages, work, HTML)


CLEAN = pa.schema([("page_id", pa.int64()), ("html", pa.string()), ("dropped", pa.int32())])


def sanitise(pages: DataFrame, safe: safelist.Safelist | str = "basic") -> DataFrame:
    """Body markup of what a safelist (or a preset's name) allows, and how much was dropped."""
    rules = safelist.PRESETS[safe]() if isinstance(safe, str) else safe

    def work(k, h, u):
        out, dropped = safelist.clean_document(document(h, u), rules)
        return [(k, X.inner_html(out.children[0].children[1]), dropped)]

    return per_page(pages, work, CLEAN)


def edit(pages: DataFrame, css: str, operation: str, argument: str = "") -> DataFrame:
    """Pages with an operation of ``tagweave.markup.edit`` applied to every match."""
    change = E.OPERATIONS[operation]

    def work(k, h, u):
        doc = document(h, u)
        for e in match.select(doc, css, doc.base_uri):
            if e.parent is not None:
                change(e, argument)
        return [(k, X.outer_html(doc))]

    return per_page(pages, work, HTML)


def filter_pages(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Markup of pages after a filtering walk: of the rules (selector, outcome) the first that an element matches
    decides. Outcomes: continue, skip_children and skip_entirely (what is below is not looked at), remove, stop."""
    plans = [(selector.parse(css), Outcome(outcome)) for css, outcome in rules]

    def work(k, h, u):
        doc = document(h, u)
        hits = [({id(e) for e in match.select(doc, css, doc.base_uri)}, outcome) for (css, _), (_, outcome) in zip(rules, plans, strict=True)]
        filter_nodes(doc, lambda n, _: next((o for found, o in hits if id(n) in found), Outcome.CONTINUE))
        return [(k, X.outer_html(doc))]

    return per_page(pages, work, HTML)


VISITED = pa.schema([("page_id", pa.int64()), ("step", pa.int32()), ("event", pa.string()), ("node", pa.string()), ("depth", pa.int32())])


def visits(pages: DataFrame, mode: str = "html") -> DataFrame:
    """The steps of a walk over each page: every node as it is entered (head) and left (tail)."""

    def work(k, h, u):
        out: list = []
        traverse(document(h, u, mode), lambda n, d: out.append((k, len(out), "head", n.tag, d)), lambda n, d: out.append((k, len(out), "tail", n.tag, d)))
        return out

    return per_page(pages, work, VISITED)


DOCUMENTS = pa.schema([
    ("page_id", pa.int64()), ("location", pa.string()), ("base_uri", pa.string()), ("doctype", pa.string()), ("public_id", pa.string()), ("system_id", pa.string()), ("quirks", pa.bool_()), ("charset", pa.string()), ("title", pa.string()),
    ("head", pa.string()), ("body", pa.string()), ("elements", pa.int32()), ("nodes", pa.int32()),
])


def documents(pages: DataFrame) -> DataFrame:
    """One row of facts on each page: address, doctype, quirks mode, declared character set, title, markup of head and body."""

    def work(k, h, u):
        doc = document(h, u)
        every = list(doc.walk())
        doctype = next((dict(n.attrs) for n in doc.children if n.kind == "doctype"), {})
        meta = next((e for e in every if e.tag == "meta" and e.attr("charset")), None)
        head, body = (next((e for e in every if e.tag == t), None) for t in ("head", "body"))
        title = next((e for e in head.walk() if e.tag == "title"), None) if head is not None else None
        inside = lambda e: X.inner_html(e) if e is not None else None
        return [(k, u, doc.base_uri, doctype.get("name"), doctype.get("publicId"), doctype.get("systemId"), doc.quirks, meta.attr("charset") if meta is not None else None,
                 X.text(title).strip() if title is not None else "", inside(head), inside(body), sum(n.kind == "element" for n in every), len(every))]

    return per_page(pages, work, DOCUMENTS)


def with_charset(pages: DataFrame, charset: str, mode: str = "html") -> DataFrame:
    """Markup of pages that declares a character set, with what it can't hold as references."""

    def work(k, h, u):
        doc = document(h, u, mode)
        E.set_charset(doc, charset)
        return [(k, X.outer_html(doc, mode == "xml", charset=charset))]

    return per_page(pages, work, HTML)


def with_title(pages: DataFrame, title: str) -> DataFrame:
    def work(k, h, u):
        doc = document(h, u)
        E.set_title(doc, title)
        return [(k, X.outer_html(doc))]

    return per_page(pages, work, HTML)


PATHS = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("selector", pa.string())])


def css_selectors(pages: DataFrame, css: str) -> DataFrame:
    """For every match a selector that finds it alone."""
    selector.parse(css)

    def work(k, h, u):
        doc = document(h, u)
        return [(k, i, path) for i, path in enumerate(scripts.css_selectors(doc, match.select(doc, css, doc.base_uri)))]

    return per_page(pages, work, PATHS)


VALID = pa.schema([("page_id", pa.int64()), ("valid", pa.bool_())])


def is_clean(pages: DataFrame, safe: safelist.Safelist | str = "basic") -> DataFrame:
    """Whether whole pages have nothing in their bodies that a safelist would drop, and nothing in their heads."""
    rules = safelist.PRESETS[safe]() if isinstance(safe, str) else safe
    return per_page(pages, lambda k, h, u: [(k, safelist.is_valid_document(document(h, u), rules))], VALID)


def is_valid(pages: DataFrame, safe: safelist.Safelist | str = "basic") -> DataFrame:
    """Whether a body fragment has nothing that a safelist would drop and no errors."""
    rules = safelist.PRESETS[safe]() if isinstance(safe, str) else safe
    return per_page(pages, lambda k, h, u: [(k, safelist.is_valid(h, rules))], VALID)


# The metadata fields with the selectors and attributes that they come from.
METADATA = {
    "ogTitle": ("meta[property=og:title]", "content"), "ogSiteName": ("meta[property=og:site_name]", "content"), "ogType": ("meta[property=og:type]", "content"),
    "ogLocale": ("meta[property=og:locale]", "content"), "ogDescription": ("meta[property=og:description]", "content"), "ogImage": ("meta[property=og:image]", "content"),
    "ogUrl": ("meta[property=og:url]", "content"), "twitterTitle": ("meta[name=twitter:title]", "content"), "twitterCard": ("meta[name=twitter:card]", "content"),
    "twitterDescription": ("meta[name=twitter:description]", "content"), "twitterImage": ("meta[name=twitter:image]", "content"), "title": ("meta[name=title]", "content"),
    "description": ("meta[name=description]", "content"), "canonical": ("link[rel=canonical]", "href"), "author": ("meta[name=author]", "content"),
    "favicon": ("link[rel~=icon]", "href"), "shortcutIcon": ("link[rel~=shortcut icon]", "href"),
}


def metadata(nodes: DataFrame, more: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per page: the metadata fields, null where the page has no such tag, and htmlTitle. ``more`` names
    further fields, each with a selector without combinators and the attribute that it comes from.

    One scan of the nodes and one aggregation by page; icons are put behind the page's address as they are
    unless they begin with http.
    """
    aggs = []
    for name, (css, attr) in (METADATA | (more or {})).items():
        test = R.predicate(selector.parse(css))
        aggs.append(F.min_by(F.when(test, F.coalesce(N.attr(attr), F.lit(""))), F.when(test, F.col("pre"))).alias(name))
    scoped = nodes.withColumns({"scope": F.lit(0)}).withColumn("attrs", F.coalesce("attrs", F.array().cast("array<struct<name:string,value:string>>")))
    base = F.max("base_uri").alias("__base")
    out = scoped.groupBy("doc", "page_id").agg(base, *aggs)
    for icon in ("favicon", "shortcutIcon"):
        out = out.withColumn(icon, F.when(F.lower(icon).startswith("http"), F.col(icon)).otherwise(F.concat("__base", F.col(icon))))
    return out.drop("__base").join(_titles(nodes).select("doc", F.col("title").alias("htmlTitle")), "doc", "left").drop("doc")


CONTROLS = pa.schema([("page_id", pa.int64()), ("form", pa.int32()), ("ord", pa.int32()), ("action", pa.string()), ("method", pa.string()), ("name", pa.string()), ("value", pa.string())])


def form_data(pages: DataFrame) -> DataFrame:
    """What each form would send: a row for every successful control, those outside the form's subtree too."""

    def value(e) -> list[str]:
        if e.tag == "select":
            options = [o for o in e.walk() if o.tag == "option"]
            chosen = [o for o in options if o.attr("selected") is not None]
            if not chosen and options and e.attr("multiple") is None:
                chosen = options[:1]
            return [o.attr("value") if o.attr("value") is not None else X.text(o) for o in chosen]
        if e.tag == "textarea":
            return [X.whole_text(e)]
        if (e.attr("type") or "").lower() in ("checkbox", "radio"):
            return [e.attr("value") or "on"] if e.attr("checked") is not None else []
        return [e.attr("value") or ""]

    def work(k, h, u):
        doc, out = document(h, u), []
        number: dict[int, int] = {}
        found = [e for e in doc.walk() if e.tag == "form" and e.kind == "element"]
        for i, form in enumerate(found):
            number[id(form)] = i
        owner: dict[int, list[int]] = {}
        todo = [(doc, ())]
        while todo:  # the forms that an element is below, outermost first
            n, forms = todo.pop()
            forms = (*forms, number[id(n)]) if id(n) in number else forms
            if n.kind == "element" and n.tag in FORM_SUBMIT:
                owner[id(n)] = list(dict.fromkeys([*forms, *([number[id(n.form)]] if n.form is not None and id(n.form) in number else [])]))
            todo.extend((c, forms) for c in n.children)
        for e in doc.walk():
            if owner.get(id(e)) and e.attr("name") and e.attr("disabled") is None and (e.attr("type") or "").lower() not in ("button", "image", "submit", "reset"):
                for i in owner[id(e)]:
                    form = found[i]
                    out += [(k, i, match.attribute(form, "abs:action", doc.base_uri) or u, (form.attr("method") or "get").lower(), e.attr("name"), v) for v in value(e)]
        return [(*r[:2], i, *r[2:]) for i, r in enumerate(sorted(out, key=lambda r: r[1]))]

    return per_page(pages, work, CONTROLS)


def form_requests(controls: DataFrame) -> DataFrame:
    """(page_id, form, url, method, params) of what ``form_data`` found: a GET carries its values in the address."""
    pair = F.concat(F.url_encode("name"), F.lit("="), F.url_encode("value"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", pair.alias("p")))), lambda x: x["p"]), "&")
    out = controls.groupBy("page_id", "form", "action", "method").agg(joined.alias("q"))
    get = F.col("method") != "post"
    url = F.when(get, F.concat("action", F.when(F.col("action").contains("?"), "&").otherwise("?"), "q")).otherwise(F.col("action"))
    return out.select("page_id", "form", url.alias("url"), F.when(get, "get").otherwise("post").alias("method"), F.when(get, "").otherwise(F.col("q")).alias("params"))


FORMS = pa.schema([("page_id", pa.int64()), ("form", pa.int32()), ("id", pa.string()), ("action", pa.string()), ("method", pa.string()), ("controls", pa.int32())])


def forms(pages: DataFrame, css: str = "form") -> DataFrame:
    """The forms of each page that match, with how many controls belong to them."""
    selector.parse(css)

    def work(k, h, u):
        doc, out = document(h, u), []
        owned: dict[int, set[int]] = {}
        for e in doc.walk():
            if e.form is not None:
                owned.setdefault(id(e.form), set()).add(id(e))
        for i, f in enumerate(e for e in match.select(doc, css, doc.base_uri) if e.tag == "form"):
            inside = {id(n) for n in f.walk() if n.kind == "element" and n.tag in FORM_LISTED}
            out.append((k, i, f.attr("id"), match.attribute(f, "abs:action", doc.base_uri) or u, (f.attr("method") or "get").lower(), len(inside | owned.get(id(f), set()))))
        return out

    return per_page(pages, work, FORMS)


def _titles(nodes: DataFrame) -> DataFrame:
    found = RT.with_text(nodes, R.select_first(nodes, "head title"))
    return found.select("doc", "page_id", F.trim(N.normalise_whitespace(F.col("text"))).alias("title"))


def titles(nodes: DataFrame) -> DataFrame:
    """(page_id, title) of the pages that have one."""
    return _titles(nodes).drop("doc")
