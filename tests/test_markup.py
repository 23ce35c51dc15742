"""Parsing, errors, output and large pages, on documents in memory."""

import time

import pytest

from tagweave.markup import edit, match, safelist, scripts, text
from tagweave.markup.tree import KEEP, HtmlBuilder, parse, parse_fragment, parse_xml
from tagweave.operators.parse import _positions


def errors_of(html):
    found = []
    parse(html, errors=found)
    at = _positions(html)
    return [(f"{at(pos)['line']}:{at(pos)['col']}", message) for pos, message in found]


def test_errors_of_tokens_and_of_tree_construction_in_order():
    assert errors_of("<p>One</p href='no'>\n<!DOCTYPE html>\n&arrgh;<font />&#33 &amp &#x110000;<br /></div><foo") == [
        ("1:21", "Attributes incorrectly present on end tag [/p]"),
        ("2:16", "Unexpected Doctype token [<!doctype html>] when in state [InBody]"),
        ("3:2", "Invalid character reference: invalid named reference [arrgh]"),
        ("3:16", "Tag [font] cannot be self closing; not a void tag"),
        ("3:20", "Invalid character reference: missing semicolon on [&#33]"),
        ("3:25", "Invalid character reference: missing semicolon on [&amp]"),
        ("3:36", "Invalid character reference: character [1114112] outside of valid range"),
        ("3:48", "Unexpected EndTag token [</div>] when in state [InBody]"),
        ("3:53", "Unexpectedly reached end of file (EOF) in input state [TagName]"),
    ]


ERRORS = {
    "<body><div><p>One<p>Two</div></body>": 0, "<p>test<br/>test<br/></p>": 0, "<p>test</p>\n\n<div /><div>Two</div>": 1, "<!doctype html><!doctype something></div>": 2,
    "<head></head><meta charset=UTF8><p>Hello": 1, "<ruby><rp>(<rt>Hello<rt>Hello<rp>)</ruby>\n": 0, "<ruby><div><rp>Hello": 2, "<p x=1 X=2>": 1, "<!---- dash ---->": 0,
    "<p>x</b></i><table><td>q</table></div>": 4, "<b>x</p></b>": 1, "<b><p>x</b></p>": 1, "<div>": 1, "<li>a<li>b": 0, "<table><tr><td>1</table>": 0, "<a href=1>x<a href=2>y</a>": 1, "<h1>a<h2>b</h2>": 1,
    "<form><form>": 2, "<title>x": 1, "<select></option></select>": 1, "<x-y/>t</x-y>": 1, "<table>x</table>": 1,
}


@pytest.mark.parametrize("html", ERRORS)
def test_number_of_errors(html):
    assert len(errors_of(html)) == ERRORS[html], errors_of(html)


def test_valid_needs_clean_markup():
    basic = safelist.basic()
    assert safelist.is_valid("<p>Test <b>ok</b></p>", basic) and safelist.is_valid("<p>test<br/>test<br/></p>", basic)
    for html in ("<b>x</p></b>", "<p>x</div></p>", "<script>1</script>", "<p onclick=1>x</p>", "<b>x", "<!-- c -->"):
        assert not safelist.is_valid(html, basic), html
    assert safelist.is_valid_document(parse("<p>x"), basic) and not safelist.is_valid_document(parse("<title>t</title><p>x"), basic)


PRETTY = {
    "<div><p>Hello</p><p>there</p></div>": "<div>\n <p>Hello</p>\n <p>there</p>\n</div>",
    "<div>   <p>  a   b </p> text <b>c</b> d</div>": "<div>\n <p>a b</p> text <b>c</b> d\n</div>",
    "<p>One<br>Two</p>": "<p>One<br>\n Two</p>",
    "<ul><li>a<li>b <i>c</i></ul>": "<ul>\n <li>a</li>\n <li>b <i>c</i></li>\n</ul>",
    "<div>x<div>y</div></div>": "<div>\n x\n <div>\n  y\n </div>\n</div>",
    "<pre>  a\n b</pre>": "<pre>  a\n b</pre>",
    "<span>a</span><span>b</span>": "<span>a</span><span>b</span>",
    "<table><tr><td>1<td>2</table>": "<table>\n <tbody>\n  <tr>\n   <td>1</td>\n   <td>2</td>\n  </tr>\n </tbody>\n</table>",
}


@pytest.mark.parametrize("html", PRETTY)
def test_pretty(html):
    body = match.select(parse(html), "body")[0]
    assert text.inner_markup(body, text.Output()) == PRETTY[html]


def test_output_settings():
    body = match.select(parse("<p>a <b>b</b></p>"), "body")[0]
    assert text.inner_markup(body, text.Output(outline=True)) == "<p>\n a \n <b>b</b>\n</p>"
    deep = parse("<div>" * 40 + "x")
    widest = max(len(line) - len(line.lstrip()) for line in text.pretty_html(deep, 4).splitlines())
    assert widest == 30
    assert max(len(line) - len(line.lstrip()) for line in text.markup(deep, text.Output(indent=4, most_padding=-1)).splitlines()) > 100
    doc = parse("<!DOCTYPE html PUBLIC '-//W3C//DTD HTML 4.01//EN' 'http://x/'><input checked value=''><p 1a='b' b\x01c=d>é&nbsp;☃</p>")
    plain = text.outer_html(doc, charset="ascii")
    assert plain.startswith('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://x/"><html>') and "<input checked value=\"\">" in plain and "&eacute;&nbsp;&#x2603;" in plain and "b_c" in plain
    xml = text.outer_html(match.select(parse("<p 1a=b c><script>a<b</script><br>"), "p")[0], xml=True)
    assert xml == '<p c=""><script>//<![CDATA[\na<b\n//]]></script><br /></p>'


def test_settings_keep_the_case_of_names():
    doc = parse("<Div CLASS=a ID=B><P>x</P></Div>", settings=KEEP)
    assert text.inner_html(match.select(doc, "body")[0]) == '<Div CLASS="a" ID="B"><P>x</P></Div>'
    assert len(match.select(doc, "div > p")) == 1 and match.select(doc, ".a")[0].attr("id") == "B"
    assert text.outer_html(parse_xml("<A B='1'/>"), xml=True) == '<A B="1" />'


def test_fragments_by_context():
    row = parse_fragment("<td>1<td>2", "tr")
    assert [n.tag for n in row] == ["td", "td"] and [n.tag for n in parse_fragment("<td>1", "body") if n.kind == "element"] == []
    assert parse_fragment("<b>x", "textarea")[0].value == "<b>x"


def test_selectors_of_elements():
    doc = parse("<div id=o><div class=c><p>1</p><p>2</p></div></div><i id=d></i><i id=d></i>")
    p, i = match.select(doc, "p")[1], match.select(doc, "i")[1]
    assert scripts.css_selector(p, doc) == "html > body > div > div.c > p:nth-child(2)" and scripts.css_selector(match.select(doc, "#o")[0], doc) == "#o"
    assert scripts.css_selector(i, doc) == "html > body > i:nth-child(3)"


def test_attribute_ranges():
    html = "<p id=x class='a b' data-q>"
    p = match.select(parse(html), "p")[0]
    assert [(n, html[a:b], html[c:d]) for n, a, b, c, d in p.ranges] == [("id", "id", "x"), ("class", "class", "a b"), ("data-q", "data-q", "")]


DEEP, WIDE = "<div>" * 3000 + "x" + "</div>" * 3000, "<ul>" + "<li><b>x</b>y" * 20_000 + "</ul>"


@pytest.mark.parametrize("page", [DEEP, WIDE, "<table>" + "x<b>y</b>" * 5000 + "</table>"], ids=["deep", "wide", "fostered"])
def test_work_grows_with_the_page(page):
    doc = parse(page)
    for work in (
        lambda: text.text(doc), lambda: text.outer_html(doc), lambda: text.pretty_html(doc), lambda: match.select(doc, "div:has(p), li:has(> b) ~ li"), lambda: match.select(doc, "div div, li + li"),
        lambda: match.select(doc, "li:last-child"), lambda: list(doc.walk()),
    ):
        began = time.process_time()
        work()
        assert time.process_time() - began < 2.5


def test_paths_of_many_siblings_take_one_pass():
    doc = parse(WIDE)
    began = time.process_time()
    found = match.select(doc, "li")
    assert len(set(scripts.css_selectors(doc, found))) == 20_000 and time.process_time() - began < 3


def test_fostering_takes_constant_time():
    times = []
    for n in (2000, 8000):
        began = time.process_time()
        parse("<table>" + "<b>x</b>" * n)
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0] + 0.2


def test_builder_as_a_whole_has_no_errors_without_a_list():
    builder = HtmlBuilder("<p></b>")
    assert builder.build() and builder.tokens.errors is None


def test_edits_of_wide_parents():
    doc = parse(WIDE)
    for e in match.select(doc, "b"):
        edit.unwrap(e)
    assert not match.select(doc, "b")


def test_texts_as_elements():
    doc = parse("<p class=k>One<br>Two</p><div>x</div>")
    found = match.select(doc, "p:matchText")
    assert [text.text(e) for e in found] == ["One", "Two"] and [e.attr("class") for e in found] == ["k", "k"]
    assert text.outer_html(match.select(doc, "body")[0]) == '<body><p class="k">One<br>Two</p><div>x</div></body>'
    assert [text.text(e) for e in match.select(parse("<p>One<br>Two</p>"), "p:matchText:first-child")] == ["One"]


def test_same_value_and_copies():
    a, b = parse("<p id=1>x<b>y</b></p>"), parse("<p id=1>x<b>y</b></p>")
    assert a.same_value(b) and a.deep_copy().same_value(a) and not a.same_value(parse("<p id=2>x<b>y</b></p>"))
    p = match.select(a, "p")[0]
    assert p.copy().children == [] and p.copy().attr("id") == "1" and p.copy().parent is None
