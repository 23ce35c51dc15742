"""Streaming parsers, walks, whole-page operators, and reading from a server on this machine."""

import http.server
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tagweave.markup import edit, match, text
from tagweave.markup.stream import StreamParser
from tagweave.markup.traverse import Nodes, Outcome, filter_nodes, traverse
from tagweave.markup.tree import parse, parse_xml
from tagweave.operators import lists as L
from tagweave.operators import pages as P
from tagweave.operators import select as R
from tagweave.operators.parse import parse_pages
from tagweave.sources import http as H
from tagweave.streaming import pages as S

PAGE = "<title>Test</title></head><div id=1>D1</div><div id=2>D2<p id=3><span>P One</p><p id=4>P Two</p></div><div id=5>D3<p id=6>P three</p>"


def seen(stream):
    def more(e):
        siblings = e.parent.elements() if e.parent is not None else [e]
        return siblings[-1] is not e

    out = ""
    for e in stream:
        own = text.own_text(e)
        out += e.raw_tag + (f"#{e.attr('id')}" if e.attr("id") else "") + (f"[{own}]" if own else "") + ("+" if more(e) else "") + ";"
    return out


def test_elements_come_when_they_are_complete():
    assert seen(StreamParser(PAGE)) == "title[Test];head+;div#1[D1]+;span[P One];p#3+;p#4[P Two];div#2[D2]+;p#6[P three];div#5[D3];body;html;#root;"
    xml = PAGE.replace("<title>Test</title></head><div id=1>D1</div>", "<outmost><DIV id=1>D1</DIV>").replace("<p id=3><span>P One</p>", "<p id=3><span>P One</span></p>")
    assert seen(StreamParser(xml, mode="xml")) == "DIV#1[D1]+;span[P One];p#3+;p#4[P Two];div#2[D2]+;p#6[P three];div#5[D3];outmost;#root;"
    assert seen(StreamParser("<p>One<p>Two")) == "head+;p[One]+;p[Two];body;html;#root;"


def test_every_element_comes_once():
    html = "<table>x<b>y</table><b><p>1</b>2<div><a>3<a>4</div><svg><g/></svg><select><option>a<option>b"
    doc = parse(html)
    assert sorted(e.tag for e in StreamParser(html)) == sorted(n.tag for n in doc.walk() if n.kind in ("element", "document"))
    stream = StreamParser(html)
    assert text.outer_html(stream.complete()) == text.outer_html(doc)


def test_selecting_reads_no_further_than_it_must():
    html = "<p id=1>One<p id=2>Two<div>" + "x<b>y</b>" * 1000
    stream = StreamParser(html)
    assert stream.expect_first("p").attr("id") == "1" and stream.read < 40
    assert stream.select_next("p[id=2]").attr("id") == "2" and stream.read < 60
    assert stream.select_first("p").attr("id") == "1" and stream.select_next("p") is None
    with pytest.raises(LookupError):
        stream.expect_next("i")
    with StreamParser(html) as stopped:
        stopped.expect_next("p")
        stopped.stop()
        assert list(stopped) == [] and "y" not in text.text(stopped.document)
    assert [n.tag for n in StreamParser("<td>1<td>2", context="tr").complete_fragment()] == ["td", "td"]


def test_visitors():
    doc = parse("<div><p>Hello</p></div><div>There</div>")
    steps = []
    traverse(match.select(doc, "body")[0], lambda n, d: steps.append(f"<{n.tag}{d}>"), lambda n, d: steps.append(f"</{n.tag}>"))
    assert "".join(steps) == "<body0><div1><p2><#text3></#text></p></div><div1><#text2></#text></div></body>"
    traverse(doc, lambda n, d: n.remove() if n.tag == "p" else None)
    assert text.outer_html(match.select(doc, "body")[0]) == "<body><div></div><div>There</div></body>"
    again = Nodes(doc, "element")
    assert next(again).tag == "html" and next(again).tag == "head"
    again.restart(match.select(doc, "body")[0])
    assert [n.tag for n in again] == ["body", "div", "div"]


FILTERS = {
    "continue": ("", "<div><#root></#text>"), "skip_children": ("p", None), "skip_entirely": ("p", None), "remove": ("p", "<div></div><div>There be</div>"), "stop": ("p", None),
}


def test_filters():
    def run(outcome, at_tail=False):
        doc = parse("<div><p>Hello</p></div><div>There be</div>")
        body, steps = match.select(doc, "body")[0], []

        def head(n, d):
            steps.append(f"<{n.tag}>")
            return outcome if n.tag == "p" and not at_tail else Outcome.CONTINUE

        def tail(n, d):
            steps.append(f"</{n.tag}>")
            return outcome if n.tag == "p" and at_tail else Outcome.CONTINUE

        filter_nodes(body, head, tail)
        return "".join(steps), text.inner_html(body)

    whole = "<div><p>Hello</p></div><div>There be</div>"
    assert run(Outcome.CONTINUE) == ("<body><div><p><#text></#text></p></div><div><#text></#text></div></body>", whole)
    assert run(Outcome.SKIP_CHILDREN) == ("<body><div><p></p></div><div><#text></#text></div></body>", whole)
    assert run(Outcome.SKIP_ENTIRELY) == ("<body><div><p></div><div><#text></#text></div></body>", whole)
    assert run(Outcome.REMOVE) == ("<body><div><p></div><div><#text></#text></div></body>", "<div></div><div>There be</div>")
    assert run(Outcome.STOP) == ("<body><div><p>", whole)
    assert run(Outcome.REMOVE, True)[1] == "<div></div><div>There be</div>" and run(Outcome.STOP, True)[0].endswith("</p>")


def test_edits_of_documents():
    doc = parse("<meta name=charset content=x><p>Hello there")
    edit.set_charset(doc, "ISO-8859-1"), edit.set_title(doc, "T")
    assert text.inner_html(match.select(doc, "head")[0]) == '<meta charset="ISO-8859-1"><title>T</title>'
    p = match.select(doc, "p")[0]
    edit.split_text(p, "5")
    assert [c.value for c in p.children] == ["Hello", " there"]
    edit.insert_children(p, -1, [parse("x").children[0]])
    assert p.children[-1].tag == "html" and edit.has_parent(p) and not edit.has_attributes(p)
    edit.remove_range(p, 1, 3)
    edit.append_to(p.children[0], match.select(doc, "body")[0])
    assert text.inner_html(match.select(doc, "body")[0]) == "<p></p>Hello"
    xml = parse_xml("<a/>")
    edit.set_charset(xml, "utf-8")
    assert text.outer_html(xml, xml=True) == '<?xml version="1.0" encoding="utf-8"?><a />'
    comment = next(n for n in parse("<?xml version='1.0'?><p>").walk() if n.kind == "comment")
    assert edit.as_declaration(comment).value == "xml version='1.0'" and edit.as_declaration(next(n for n in parse("<!-- x -->").walk() if n.kind == "comment")) is None
    e = match.select(parse("<textarea>a</textarea>"), "textarea")[0]
    edit.set_value(e, "b"), edit.append_element(e, "i"), edit.clear_attrs(e)
    assert text.outer_html(e) == "<textarea>b<i></i></textarea>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://h/d/", "<!doctype html><title>A</title><meta charset=utf-8><form id=f action=/go method=POST><input name=a value='1 2'><textarea name=t>x&y</textarea></form><p>1<p class=k>2"), (2, "http://h/", None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_page_operators(pages, spark):
    got = {r.page_id: r for r in P.documents(pages).collect()}
    assert (got[1].doctype, got[1].quirks, got[1].charset, got[1].title, got[1].location) == ("html", False, "utf-8", "A", "http://h/d/")
    assert got[2].quirks and got[2].doctype is None and got[2].body == ""
    assert P.select_streaming(pages, "p", most=1).select("text").collect()[0].text == "1" and P.select_streaming(pages, "p", most=None).count() == 2
    kept = P.filter_pages(pages, [("form", "remove"), (".k", "remove"), ("p", "skip_children")]).where("page_id = 1").first().html
    assert "<form" not in kept and "<p>1</p>" in kept and "k" not in kept.split("<body>")[1]
    assert P.visits(pages).where("page_id = 2").count() == 8
    assert 'charset="ascii"' in P.with_charset(pages, "ascii").where("page_id = 1").first().html and "<title>B</title>" in P.with_title(pages, "B").where("page_id = 2").first().html
    assert [(r.action, r.method, r.controls) for r in P.forms(pages).collect()] == [("http://h/go", "post", 2)]
    assert [(r.url, r.method, r.params) for r in P.form_requests(P.form_data(pages)).collect()] == [("http://h/go", "post", "a=1+2&t=x%26y")]
    assert [r.tag for r in P.select_by(pages, lambda e: len(e.attrs) > 2).collect()] == ["form"]
    nodes = parse_pages(pages)
    assert [r.enc for r in P.metadata(nodes, {"enc": ("meta[charset]", "charset")}).orderBy("page_id").collect()] == ["utf-8", None]
    fields = R.select(nodes, "input, textarea")
    assert sorted(r.value for r in L.value(nodes, fields.drop("value")).collect()) == ["1 2", "x&y"]
    p = R.select(nodes, "p")
    assert L.retain(p, R.select(nodes, ".k")).count() == 1 and L.remove_all(p, R.select(nodes, ".k")).count() == 1 and L.remove_if(p, F.col("eidx") > 1).count() == 1
    assert L.has_class(p, "K").count() == 1 and L.has_attr(p, "class").count() == 1
    with pytest.raises(Exception, match="no match of 'p' in page 2"):
        P.select_pages(pages, "p", expected=True).collect()
    assert P.select_pages(pages, "body", expected=True).count() == 2
    assert [r.valid for r in P.is_clean(spark.createDataFrame([(1, "", "<p>x"), (2, "", "<title>t</title>")], pages.schema)).orderBy("page_id").collect()] == [True, False]


class Server(http.server.BaseHTTPRequestHandler):
    calls: dict = {}

    def answer(self, body=""):
        path = urllib.parse.urlsplit(self.path).path
        Server.calls[path] = Server.calls.get(path, 0) + 1
        if path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/ok")
            self.end_headers()
            return
        status = 404 if path == "/none" else 503 if path == "/busy" and Server.calls[path] < 2 else 200
        self.send_response(status)
        self.send_header("Content-Type", "text/html; charset=iso-8859-1")
        self.end_headers()
        self.wfile.write(f"<p>é {self.command} {self.path} {body} {self.headers.get('X-Own', '')}</p>".encode("latin-1"))

    def do_GET(self):
        self.answer()

    def do_POST(self):
        self.answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_pages_from_a_server(spark, server):
    H.register(spark)
    urls = " ".join(f"{server}/{p}" for p in ("ok", "moved", "none", "busy")) + " http://127.0.0.1:1/ nonsense"
    rows = {r.requested: r for r in spark.read.format("http_pages").option("urls", urls).option("headers", '{"X-Own": "h1"}').option("retries", 1).option("timeout", 5).load().collect()}
    assert rows[f"{server}/ok"].html == "<p>é GET /ok  h1</p>" and rows[f"{server}/ok"].charset.lower() == "iso-8859-1"
    assert rows[f"{server}/moved"].url == f"{server}/ok" and rows[f"{server}/busy"].status == 200
    assert rows[f"{server}/none"].status == 404 and rows[f"{server}/none"].html is None and rows["http://127.0.0.1:1/"].error and rows["nonsense"].error
    page = spark.createDataFrame([(1, f"{server}/x", "<form action=/go method=post><input name=a value='1 2'></form><form action=/find><input name=q value=z></form>")], "page_id bigint, url string, html string")
    got = sorted(r.html for r in H.send(P.form_requests(P.form_data(page))).collect())
    assert got == ["<p>é GET /find?q=z  </p>", "<p>é POST /go a=1+2 </p>"]


def test_streams_of_pages(spark, tmp_path):
    rows = [(1, "http://h/", "<a href=x>l</a>", "2024-01-01 00:10:00"), (2, "http://h/", "<a href=x>m</a><a href=y>n</a>", "2024-01-01 00:20:00"), (3, "http://h/", "", "2024-01-01 01:20:00")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    found = run(S.links(S.read_page_stream(spark, str(tmp_path / "in"))), "links_of_stream", "append")
    assert sorted((r.page_id, r.href) for r in found) == [(1, "http://h/x"), (2, "http://h/x"), (2, "http://h/y")]
    timed = spark.readStream.schema("page_id bigint, url string, html string, at timestamp").parquet(str(tmp_path / "in"))
    counts = run(S.counts_by_window(timed, "at", "url"), "counts_of_stream", "complete")
    assert sorted(r.n for r in counts) == [1, 2]
    assert len(run(S.first_seen(timed, "at", "url"), "first_of_stream", "append")) == 1
