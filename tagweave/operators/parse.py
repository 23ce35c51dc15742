"""From pages to the relation of nodes.

A node is a row; its subtree is the interval [pre, end) of document order, so every structural question
is an equality or a range on ``doc`` and these numbers. ``doc`` tells the pages apart: it is never null and
different for every row of the pages, the number of its partition with its place there. It is the same
whenever the pages come in the same order (files do; after a shuffle write them or the nodes first).
Positions among siblings are columns, so that positional selectors are plain predicates. Parsing is one
narrow pass over the pages.

A null document parses like an empty one; ``page_id`` is carried along as it is, null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tagweave.markup import tags as T
from tagweave.markup import text as X
from tagweave.markup.tree import FOLD, KEEP, Document, Node, Settings, parse, parse_fragment, parse_xml, shell

_POSITION = pa.struct([("pos", pa.int32()), ("line", pa.int32()), ("col", pa.int32())])
_RANGE = pa.struct([("start", _POSITION), ("end", _POSITION)])
_ATTR_SRC = pa.struct([("name", pa.string()), ("name_range", _RANGE), ("value_range", _RANGE)])
NODES = pa.schema([
    ("doc", pa.int64()), ("page_id", pa.int64()), ("pre", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
    ("tag_raw", pa.string()), ("ns", pa.string()), ("sib_idx", pa.int32()), ("eidx", pa.int32()), ("ecount", pa.int32()), ("tidx", pa.int32()), ("tcount", pa.int32()),
    ("attrs", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("value", pa.string()),
    ("base_uri", pa.string()), ("form_pre", pa.int32()), ("empty", pa.bool_()), ("piece", pa.string()), ("space_before", pa.bool_()), ("space_after", pa.bool_()),
    ("src", pa.struct([("start", _POSITION), ("end", _POSITION)])), ("attr_src", pa.list_(_ATTR_SRC)),
])

#: White space that ``pre`` and its like keep, set apart from white space that collapses.
KEPT = {ord(c): chr(0xE000 + k) for k, c in enumerate(" \t\n\f\r\xa0")}


def document(html: str | None, base_uri: str | None = "", mode: str = "html", errors: list | None = None, settings: Settings | None = None) -> Document:
    """mode: html, xml, fragment (the inside of a body) or fragment:NAME (the inside of an element of that name)."""
    html, base_uri = html or "", base_uri or ""
    if mode == "xml":
        return parse_xml(html, base_uri, errors, settings or KEEP)
    if mode == "html":
        return parse(html, base_uri, errors, settings or FOLD)
    doc, context = shell(base_uri), mode.partition(":")[2] or "body"
    for n in parse_fragment(html, context, base_uri, errors, settings or FOLD):
        doc.children[0].children[1].append(n)
    return doc


def _positions(source: str) -> Callable[[int], dict | None]:
    """Line and column of an offset; all in UTF-16 units, lines and columns from 1."""
    import bisect

    wide = [k for k, c in enumerate(source) if ord(c) > 0xFFFF]
    lines = [0, *(k + 1 for k, c in enumerate(source) if c == "\n")]

    def at(k: int) -> dict | None:
        if k < 0:
            return None
        line = bisect.bisect_right(lines, k) - 1
        units = lambda j: j + bisect.bisect_left(wide, j)
        return {"pos": units(k), "line": line + 1, "col": units(k) - units(lines[line]) + 1}

    return at


def rows_of(doc: Document, page_id, source: str | None = None, number: int = 0) -> list[tuple]:
    """Rows of a document in document order; positions only if the source is given."""
    out, order = [], {}
    todo: list = [(doc, -1, 0, 0, (0, 1, 1, 1))]
    at = _positions(source) if source is not None else None
    ends: dict[int, int] = {}
    base_uri = doc.base_uri
    while todo:
        item = todo.pop()
        if isinstance(item, int):
            ends[item] = len(out)
            continue
        node, parent, depth, sib, (eidx, ecount, tidx, tcount) = item
        pre = len(out)
        order[id(node)] = pre
        src = {"start": at(node.start), "end": at(node.end)} if at and node.start >= 0 else None
        if node.kind != "element":
            piece = None
            if node.kind in X.TEXT:
                piece = node.value.translate(KEPT) if node.kind == "cdata" or X.keeps_space(node.parent) else T.normalise(node.value)
            out.append((
                number, page_id, pre, 0, parent, depth, node.kind, node.tag, node.raw_tag, node.ns, sib, None, None, None,
                None, [{"name": k, "value": v} for k, v in node.attrs] if node.attrs else [], None,
                None, node.value if node.kind not in ("document", "doctype") else None,
                base_uri, None if node.form is None else id(node.form), None, piece, node.tag == "br", False, src, None,
            ))
            if not node.children:
                ends[pre] = pre + 1
                continue
        else:
            block, follow = node.tag in T.BLOCK, None
            if block and node.parent is not None and sib + 1 < len(node.parent.children):
                follow = node.parent.children[sib + 1]
            out.append((
                number, page_id, pre, 0, parent, depth, node.kind, node.tag, node.raw_tag, node.ns, sib, eidx, ecount, tidx,
                tcount, [{"name": k, "value": v} for k, v in node.attrs] if node.attrs else [], node.attr("id") if node.attrs else None,
                list(dict.fromkeys((node.attr("class") or "").lower().split())) if node.attrs else [], None,
                base_uri, None if node.form is None else id(node.form),
                all(c.kind in ("comment", "declaration", "doctype") or (c.kind == "text" and T.is_blank(c.value)) for c in node.children),
                None, block or node.tag == "br",
                block and follow is not None and (follow.kind in X.TEXT or (follow.kind == "element" and follow.tag not in T.BLOCK)), src,
                [{"name": n, "name_range": {"start": at(a), "end": at(b)}, "value_range": {"start": at(c), "end": at(d)}} for n, a, b, c, d in node.ranges] if at else None,
            ))
            if not node.children:
                ends[pre] = pre + 1
                continue
        todo.append(pre)
        counts: dict[str, int] = {}
        elements = 0
        below = []
        for k, c in enumerate(node.children):
            if c.kind == "element":
                counts[c.tag] = counts.get(c.tag, 0) + 1
                below.append((c, pre, depth + 1, k, (elements, counts[c.tag])))
                elements += 1
            else:
                below.append((c, pre, depth + 1, k, (0, 0)))
        for c, p, d, k, (e, t) in reversed(below):
            todo.append((c, p, d, k, (e, elements, t, counts.get(c.tag, 0))))
    return [(*r[:3], ends[k], *r[4:20], order.get(r[20]), *r[21:]) for k, r in enumerate(out)]


def per_page(pages: DataFrame, work: Callable[..., Iterable[tuple]], schema: pa.Schema, html: str = "html", url: str = "url", key: str = "page_id", numbered: bool = False) -> DataFrame:
    """Rows of ``work(page_id, html, url)`` for every page, or with ``numbered`` of ``work(page_id, html, url, doc)``;
    no shuffle, one page in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            keys, markup, urls, *numbers = batch.columns
            for k in range(batch.num_rows):
                for row in work(keys[k].as_py(), markup[k].as_py() or "", urls[k].as_py() or "", *(n[k].as_py() for n in numbers)):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield _batch(rows, schema)
                        rows = []
        if rows:
            yield _batch(rows, schema)

    number = [F.monotonically_increasing_id()] if numbered else []  # of the partition itself, also in a union
    return pages.select(key, html, url, *number).mapInArrow(run, from_arrow_schema(schema))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def parse_pages(pages: DataFrame, mode: str = "html", positions: bool = False, settings: Settings | None = None) -> DataFrame:
    """The nodes of pages (page_id, url, html); with ``positions`` where nodes and attributes stand in the markup."""
    return per_page(pages, lambda k, h, u, number: rows_of(document(h, u, mode, settings=settings), k, h if positions else None, number), NODES, numbered=True)


ERRORS = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("msg", pa.string())])


def parse_errors(pages: DataFrame, most: int | None = None, mode: str = "html") -> DataFrame:
    """Errors met in the markup by the tokeniser and by tree construction, in order, at most the first ``most`` of a page."""

    def work(k, h, u):
        errors: list = []
        document(h, u, mode, errors)
        at = _positions(h)
        return [(k, (p := at(pos))["pos"], p["line"], p["col"], msg) for pos, msg in errors[:most]]

    return per_page(pages, work, ERRORS)


def write_nodes(nodes: DataFrame, table: str, buckets: int = 64) -> None:
    """Save nodes bucketed by page, so that joins of the table with itself need no shuffle."""
    nodes.repartition(buckets, "doc").write.bucketBy(buckets, "doc").sortBy("doc", "pre").mode("overwrite").saveAsTable(table)
