import pytest

from tagweave.markup import match, text
from tagweave.markup.tree import parse
from tagweave.operators import find
from tagweave.operators import lists as L
from tagweave.operators import navigate as V
from tagweave.operators import pages as pages_of
from tagweave.operators import parse as P
from tagweave.operators import select as R
from tagweave.operators import text as RT
from tagweave.plans import selector

PAGES = [
    (1, "http://h.example/a/b", '<div id=main class="Box big"><p>One <b>two</b><p lang=en>Three<br>four</div><p>Five</p><ul><li>a<li class=x>b<li>c</ul><!-- c --><script>v=1</script>'),
    (2, "http://h.example/", "<title>T &amp; x</title><h1>H</h1><div><span>s1</span><span></span><em> </em><a href='/q?x=1' data-k=v>Link text</a></div><pre>  keep\n this </pre>end"),
    (3, "", None),
    (4, "http://h.example/x/", "<base href='http://other.example/d/'><table><tr><td>1<td>2</table><a href=y>z</a><div><div><p>deep</p></div>tail</div>"),
]
SELECTORS = [
    "p", "*", "#main", ".box", ".BIG", "div p", "div > p", "p + p", "div ~ p", "ul > li + li", "li:first-child", "li:last-child", "li:nth-child(2n+1)", "li:nth-child(odd)", "li:nth-last-child(2)",
    "li:eq(1)", "li:lt(2)", "li:gt(0)", "[lang]", "[lang=EN]", "[^data-]", "a[href^=/q]", "a[href$='1']", "a[href*=x]", "a[href~=q.x]", "p[lang!=en]", "p:not([lang])", "div:has(b)", "div:has(> p)",
    "div:has(span + span)", "p:has(+ p)", "p:contains(two)", "p:containsOwn(one)", "p:matches(F.ve)", "p, li, h1", "div p b, ul li.x", ":is(p, li)", "span:empty", "em:empty", "li:only-child", "b:only-child",
    "p:first-of-type", "p:last-of-type", "span:nth-of-type(2)", "html:root", ":root", "body > *", "tbody td", "a[abs:href^=http://other]", "script:containsData(v=1)", "li:nth-child(-n+2)", "div:not(:has(p))",
    "div:not(.box) > div p", "p:containsWholeText(One)", "td:not(:first-child)", "div div, p",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def nodes(spark, pages):
    return P.parse_pages(pages).cache()


@pytest.mark.parametrize("css", SELECTORS)
def test_both_ways_of_running_a_selector_agree(nodes, css):
    got = sorted((r.page_id, r.pre) for r in R.select(nodes, css).select("page_id", "pre").collect())
    want = []
    for k, url, html in PAGES:
        doc = parse(html, url)
        order = {id(n): i for i, n in enumerate(doc.walk())}
        want += [(k, order[id(n)]) for n in match.select(doc, css, doc.base_uri)]
    assert got == sorted(want)


@pytest.mark.parametrize("kind", ["text", "own", "whole", "whole_own", "data"])
def test_texts_agree(nodes, kind):
    every = R.select(nodes, "*")
    got = {(r.page_id, r.pre): r.t for r in RT.with_text(nodes, every, kind, "t").collect()}
    own = {"text": text.text, "own": text.own_text, "whole": text.whole_text, "whole_own": text.whole_own_text, "data": text.data}[kind]
    for k, url, html in PAGES:
        for i, n in enumerate(parse(html, url).walk()):
            if n.kind == "element":
                assert got[k, i] == own(n), (k, n.tag)


@pytest.mark.parametrize("css", ["", "p[", "p >", "> > p", "p:foo", ":nth-child(x)", "p:eq(a)", "[a=]", "p,,b", "div:has()"])
def test_selector_errors(css):
    with pytest.raises(selector.SelectorError):
        selector.parse(css)


def test_plans():
    assert selector.to_sexpr(selector.parse("div > p.x, a b")) == "(or (and (tag 'p') (parent (tag 'div')) (class 'x')) (and (tag 'b') (ancestor (tag 'a'))))"
    assert selector.to_sexpr(selector.parse("p:not(.a):has(b)")) == "(and (tag 'p') (has (tag 'b')) (not (class 'a')))"


CASES = {
    "<p>a<b>b<p>c</b>d": "<p>a<b>b</b></p><p><b>c</b>d</p>",
    "<table>x<tr><td>1<td>2</table>": "x<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table>",
    "<b><p>x</b>y</p>": "<b></b><p><b>x</b>y</p>",
    "<a href=1>x<a href=2>y": '<a href="1">x</a><a href="2">y</a>',
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>",
    "<p>1</p></p>2": "<p>1</p><p></p>2",
    "a</br>b": "a<br>b",
    "<select><option>a<option>b</select>c": "<select><option>a</option><option>b</option></select>c",
    "x<b": "x",
    "&copy; &amp &ampfoo &#150; &#x41; &nosuch;": "© &amp; &amp;ampfoo – A &amp;nosuch;",
    "<div/>x": "<div></div>x", "<title/>x<textarea/>y<script/>z": "x<textarea></textarea>y<script></script>z", "<b/>x<x-y/>z": "<b></b>x<x-y />z",
    "<svg viewBox=1><g/></svg>t": '<svg viewbox="1"><g /></svg>t',
    "<h1>a<h2>b": "<h1>a</h1><h2>b</h2>",
    "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>",
    "<form>a<form>b</form>": "<form>ab</form>",
    "<textarea><b></textarea>": "<textarea>&lt;b&gt;</textarea>",
    "<p><b>1<br><p>2": "<p><b>1<br></b></p><p><b>2</b></p>",
    "<button>a<button>b": "<button>a</button><button>b</button>",
    "<template><tr><td>x</template>": "",
    "<!-- a --><p x=1 X=2 y>": '<p x="1" y=""></p>',
}


@pytest.mark.parametrize("html", CASES)
def test_tree_construction(html):
    doc = parse(html)
    body = match.select(doc, "body")[0]
    assert text.inner_html(body).replace(' y=""', " y") == CASES[html].replace(' y=""', " y")


def test_nodes_are_nested_intervals(nodes):
    rows = {}
    for r in nodes.collect():
        rows[r.page_id, r.pre] = r
    for (k, pre), r in rows.items():
        assert pre < r.end
        if r.parent >= 0:
            up = rows[k, r.parent]
            assert up.pre < pre and r.end <= up.end and r.depth == up.depth + 1


def test_repeated_and_null_page_ids_stay_apart(spark):
    rows = [(7, "", "<div><p>one</p></div>qq"), (7, "", "<div><p>two</p></div>zz"), (None, "", "<div><p>three</p></div>"), (None, None, "<div><p>three</p></div>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2)
    nodes = P.parse_pages(pages)
    for css in ("div > p", "div p", "div:has(p) p", "p:contains(o), p:contains(e)"):
        got = sorted((str(r.page_id), r.text) for r in RT.with_text(nodes, R.select(nodes, css)).collect())
        assert got == [("7", "one"), ("7", "two"), ("None", "three"), ("None", "three")], css
    p = R.select(nodes, "p")
    assert L.parents(nodes, p).where("tag = 'div'").count() == 4 and V.text_nodes(nodes, p).count() == 4 and find.containing_text(nodes, "two").where("tag = 'p'").count() == 1
    assert L.first(p).count() == 4 and L.eq(p, 0).count() == 4 and sorted(r.text for r in L.joined_text(nodes, p).collect()) == ["one", "three", "three", "two"]
    assert L.closest(nodes, p, "div").count() == 4 and pages_of.metadata(nodes).count() == 4 and V.has_text(nodes, p).count() == 4
    assert nodes.select("doc").distinct().count() == 4


def test_texts_of_all_elements_on_odd_white_space(spark):
    odd = [
        "<p>a b <i> c</i> <b> </b> d</p> e<p> f </p>g<br> h <br><br>i",
        "x <pre> k  l\n</pre> m<pre>n </pre> <i> o</i><pre> </pre><pre>\t</pre> p",
        "<div><div> ä <span>ß \xa0 </span> ö</div><textarea>\n q  r </textarea> s­ t<li> <b>u</b>v</div> w <hr> y",
        "<pre>a </pre>  b<pre>\xa0 c</pre> d <![CDATA[ e ]]><svg><![CDATA[ f  g ]]> h</svg>",
        "<p>\U0001f600 one<p>zwei 中文 <b>三</b>\xa0<i> </i>end",
    ]
    nodes = P.parse_pages(spark.createDataFrame([(k, "", h) for k, h in enumerate(odd)], "page_id bigint, url string, html string"))
    got = {(r.page_id, r.pre): r.text for r in RT.with_text(nodes, find.all_elements(nodes)).collect()}
    want = {(k, pre): text.text(n) for k, h in enumerate(odd) for pre, n in enumerate(parse(h).walk()) if n.kind == "element"}
    assert got == want and len(want) > 40


def test_texts_of_a_wide_page_are_not_counted_out_from_its_beginning(spark):
    """Each text cut by characters cost a pass over what is before it: 10**10 steps and more here."""
    import time

    n = 16_000
    nodes = P.parse_pages(spark.createDataFrame([(1, "", "".join(f"<p>{'äöü ' * 60}{k}." for k in range(n)))], "page_id bigint, url string, html string")).cache()
    nodes.count()
    began = time.perf_counter()
    assert find.matching_text(nodes, "ü 77[.]").where("tag = 'p'").count() == 1
    assert time.perf_counter() - began < 25
    nodes.unpersist()


def test_pieces_of_texts_are_sorted_without_a_function_for_each_comparison(nodes):
    for found in (find.matching_own_text(nodes, "^.{1,3}$"), find.containing_text(nodes, "o")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array(" in plan and "array_sort(" not in plan, plan


def test_relatives_are_found_without_making_whole_rows_distinct(nodes):
    for found in (L.children(nodes, R.select(nodes, "ul")), V.child(nodes, R.select(nodes, "ul"), 0)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "LeftSemi" in plan, plan
    assert [r.tag for r in L.children(nodes, R.select(nodes, "ul, ul").unionByName(R.select(nodes, "ul"))).collect()] == ["li"] * 3
