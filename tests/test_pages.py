import pytest

from tagweave.functions import strings as N
from tagweave.markup import edit, match, safelist, text, urls
from tagweave.markup.tree import parse, parse_xml
from tagweave.operators import lists as L
from tagweave.operators import pages as P
from tagweave.operators import select as R
from tagweave.operators.parse import parse_errors, parse_pages
from tagweave.sources import files
from tagweave.streaming import pages as S

HTML = "<head><title> A  &amp; B</title><meta property='og:title' content=OG><link rel=icon href=/f.ico></head><ul><li id=a>1<li id=b>2<li id=c>3</ul><form action=/go><input name=x value=1><input type=checkbox name=y checked><select name=z><option>p<option selected value=Q>q</select></form>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://h.example/d/", HTML), (2, "http://h.example/", None)], "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return parse_pages(pages, positions=True).cache()


def ids(df):
    return [r.id for r in df.where("page_id = 1").orderBy("pre").collect()]


def test_lists_and_navigation(nodes):
    li = R.select(nodes, "li")
    assert ids(L.next_sibling(nodes, li)) == ["b", "c"] and ids(L.prev_sibling(nodes, li)) == ["a", "b"]
    assert ids(L.next_all(nodes, li)) == ["b", "c", "c"] and ids(L.siblings(nodes, L.first(li))) == ["b", "c"]
    assert ids(L.first(li)) == ["a"] and ids(L.last(li)) == ["c"] and ids(L.eq(li, 1)) == ["b"] and ids(L.eq(li, 7)) == []
    assert ids(L.not_matching(nodes, li, "#b")) == ["a", "c"] and ids(L.matching(nodes, li, "#b")) == ["b"]
    assert [r.tag for r in L.parents(nodes, li).orderBy("pre").collect()] == ["html", "body", "ul"]
    assert [r.tag for r in L.closest(nodes, li, "ul, body").collect()] == ["ul"] * 3
    assert [r["values"] for r in L.each_text(nodes, li).collect()] == [["1", "2", "3"]]
    assert [r["values"] for r in L.each_attr(li, "ID").collect()] == [["a", "b", "c"]]
    assert [r.text for r in L.joined_text(nodes, li).collect()] == ["1 2 3"]
    assert ids(R.select_within(nodes, R.select(nodes, "ul"), "> li:eq(2)")) == ["c"] and ids(R.select_first(nodes, "li")) == ["a"]


def test_metadata_titles_forms(pages, nodes):
    rows = {r.page_id: r for r in P.metadata(nodes).collect()}
    assert rows[1].ogTitle == "OG" and rows[1].htmlTitle == "A & B" and rows[1].description is None and rows[1].favicon == "http://h.example/d//f.ico" and rows[2].ogTitle is None
    assert [(r.name, r.value, r.action) for r in P.form_data(pages).collect()] == [("x", "1", "http://h.example/go"), ("y", "on", "http://h.example/go"), ("z", "Q", "http://h.example/go")]


def test_positions_are_utf16_units(spark):
    row = parse_pages(spark.createDataFrame([(1, "", "<p>😀\n<b>x</b>")], "page_id bigint, url string, html string"), positions=True).where("tag = 'b'").first()
    assert (row.src.start.pos, row.src.start.line, row.src.start.col) == (6, 2, 1)


def test_page_operators(pages, spark):
    assert [r.text for r in P.select_pages(pages, "li:not(#b)").collect()] == ["1", "3"]
    assert [r.text for r in P.select_pages(pages, "li", first=True).collect()] == ["1"]
    assert '<li id="b">' not in P.edit(pages, "#b", "remove").where("page_id = 1").first().html
    df = spark.createDataFrame([(1, "", "<div><p>a</div><p>b")], "page_id bigint, url string, html string")
    assert [r.tag for r in P.stream_elements(df).orderBy("emit_ord").collect()] == ["head", "p", "div", "p", "body", "html", "#root"]
    assert parse_errors(spark.createDataFrame([(1, "", "x</>")], "page_id bigint, url string, html string")).count() == 1
    assert P.serialise(df).first().html == "<html><head></head><body><div><p>a</p></div><p>b</p></body></html>"
    assert P.serialise(df, pretty=True).first().html.splitlines()[:4] == ["<html>", " <head></head>", " <body>", "  <div>"]


def test_sanitiser(pages):
    clean = lambda h, s, base="http://h.example/": safelist.clean(h, safelist.PRESETS[s](), base)
    assert clean("<p><a href='/x' onclick=1>L</a><script>x</script>", "basic") == '<p><a href="http://h.example/x" rel="nofollow">L</a></p>'
    assert clean("<b>x</b><i>y", "none") == "xy" and clean("<b>x</b><p>y", "simple_text") == "<b>x</b>y"
    assert clean("<a href='javascript:1'>x</a>", "basic") == '<a rel="nofollow">x</a>'
    assert clean("<img src='ftp://x'><img src=/i.png alt=q>", "basic_with_images") == '<img><img src="http://h.example/i.png" alt="q">'
    assert safelist.is_valid("<b>x</b>", safelist.basic()) and not safelist.is_valid("<x>y</x>", safelist.basic())
    rules = safelist.relaxed().remove_tags("p").preserve_relative_links().add_attributes(":all", "class").add_protocols("a", "href", "#")
    assert safelist.clean("<p class=c><a class=d href='#x'>t</a>", rules) == '<a class="d" href="#x">t</a>'
    assert P.sanitise(pages, "none").where("page_id = 1").first().html.startswith("123")


EDITS = {
    ("before", "<i>x</i>"): '<i>x</i><b>o</b>', ("after", "x"): "<b>o</b>x", ("append", "<u>"): "<b>o<u></u></b>", ("prepend", "x"): "<b>xo</b>", ("inner", "n"): "<b>n</b>", ("empty", ""): "<b></b>",
    ("remove", ""): "", ("unwrap", ""): "o", ("wrap", "<p><i></i></p>"): "<p><i><b>o</b></i></p>", ("replace_with", "r"): "r", ("set_text", "<"): "<b>&lt;</b>", ("append_text", "z"): "<b>oz</b>",
    ("prepend_text", "z"): "<b>zo</b>", ("rename", "em"): "<em>o</em>", ("set_attr", "k=v"): '<b k="v">o</b>', ("add_class", "c"): '<b class="c">o</b>', ("toggle_class", "c"): '<b class="c">o</b>',
}


@pytest.mark.parametrize("step", EDITS, ids=lambda s: s[0])
def test_edits(step):
    doc = parse("<div><b>o</b></div>")
    edit.OPERATIONS[step[0]](match.select(doc, "b")[0], step[1])
    assert text.inner_html(match.select(doc, "div")[0]) == EDITS[step]


# RFC 3986, 5.4: references against http://a/b/c/d;p?q
REFERENCES = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "mailto:x": "mailto:x",
}


@pytest.mark.parametrize("rel", REFERENCES)
def test_resolve(rel):
    assert urls.resolve("http://a/b/c/d;p?q", rel) == REFERENCES[rel]


def test_xml():
    doc = parse_xml('<?xml version="1.0"?><A b="1"><c/>x<![CDATA[<y>]]></A>')
    assert text.outer_html(doc, xml=True) == '<?xml version="1.0"?><A b="1"><c />x<![CDATA[<y>]]></A>'


def test_charsets():
    assert files.detect_charset(b"\xef\xbb\xbfx") == ("UTF-8", 3) and files.detect_charset(b"<meta charset='iso-8859-1'>")[0] == "iso-8859-1"
    assert files.detect_charset(b"<?xml version='1.0' encoding='koi8-r'?>")[0] == "koi8-r" and files.detect_charset(b"<meta charset=nosuch>")[0] == "UTF-8"
    assert files.decode("<p>é".encode("utf-16"))[0] == "<p>é" and files.charset_of_content_type("text/html; charset='utf-8'") == "utf-8"


def test_files_and_streams(spark, tmp_path, pages):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_bytes("<meta charset=latin-1><p>é".encode("latin-1"))
    assert [(r.html[-1], r.charset) for r in files.read_html_files(spark, str(tmp_path / "in")).collect()] == [("é", "latin-1")]
    pages.write.parquet(str(tmp_path / "pages"))
    stream = P.select_pages(S.read_page_stream(spark, str(tmp_path / "pages")), "li")
    job = stream.writeStream.format("memory").queryName("li_stream").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted(r.text for r in spark.table("li_stream").collect()) == sorted(r.text for r in P.select_pages(pages, "li").collect())
    assert [r.href for r in S.links(spark.createDataFrame([(1, "http://h/", "<a href=x>l</a>")], "page_id bigint, url string, html string")).collect()] == ["http://h/x"]


def test_string_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a \t\n b",), ("12",), ("",), ("a\"<&>",)], "t string")
    rows = df.select(N.normalise_whitespace(F.col("t")).alias("n"), N.is_blank(F.col("t")).alias("b"), N.is_numeric(F.col("t")).alias("d"), N.escape_text(F.col("t")).alias("e"), N.escape_attribute(F.col("t")).alias("q")).collect()
    assert [tuple(r)[:3] for r in rows] == [(" a b", False, False), ("12", False, True), ("", True, False), ("a\"<&>", False, False)]
    assert rows[3].e == 'a"&lt;&amp;&gt;' and rows[3].q == "a&quot;<&amp;>"


def test_registered_queries_have_fixed_columns(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["page_id", "ord", "text", "href"]


def test_finders_and_navigation(nodes):
    from tagweave.operators import find
    from tagweave.operators import navigate as V

    assert ids(find.by_id(nodes, "b")) == ["b"] and ids(find.by_tag(nodes, "LI")) == ["a", "b", "c"] and ids(find.by_class(nodes, "q")) == []
    assert ids(find.by_attribute_value_not(nodes, "id", "a").where("tag = 'li'")) == ["b", "c"] and ids(find.containing_text(nodes, "2").where("tag = 'li'")) == ["b"]
    assert ids(find.by_index_equals(nodes, 2).where("tag = 'li'")) == ["c"] and ids(find.by_index_less(nodes, 1).where("tag = 'li'")) == ["a"]
    ul = R.select(nodes, "ul")
    assert ids(V.child(nodes, ul, 0)) == ["a"] and ids(V.child(nodes, ul, -1)) == ["c"] and ids(V.child_node(nodes, ul, 1)) == ["b"]
    assert ids(V.next_node(nodes, find.by_id(nodes, "a"))) == ["b"] and ids(V.prev_node(nodes, find.by_id(nodes, "c"))) == ["b"]
    assert ids(V.first_sibling(nodes, find.by_id(nodes, "c"))) == ["a"] and ids(V.last_sibling(nodes, find.by_id(nodes, "a"))) == ["c"]
    assert [r.value for r in V.text_nodes(nodes, R.select(nodes, "li")).orderBy("pre").collect()] == ["1", "2", "3"]
    assert V.subtree(nodes, ul).count() == 7 and V.has_text(nodes, R.select(nodes, "li, input")).count() == 3 and V.roots(nodes).count() == 2


def test_selectors_of_elements_and_scripts(spark):
    from tagweave.markup import scripts

    doc = parse("<div id=x><p>1<p class='a b'>2</div><p><i>3</i></p><div id=y.z>4</div><div id=d></div><div id=d></div>")
    for e in doc.walk():
        if e.kind == "element":
            assert match.select(doc, scripts.css_selector(e, doc)) == [e]
    packed = "eval(function(p,a,c,k,e,d){return p}('0 1(2)',62,3,'var|x|y'.split('|'),0,{}))"
    assert scripts.unpack(packed) == "var x(y)" and scripts.unpack("f()") == "f()"
    assert scripts.entity("amp") == "&" and scripts.is_base_entity("copy") and not scripts.is_base_entity("hearts") and scripts.is_named_entity("hearts")
    df = spark.createDataFrame([(1, "", "<b>x</b>"), (2, "", "<x>y</x>")], "page_id bigint, url string, html string")
    assert [r.valid for r in P.is_valid(df).orderBy("page_id").collect()] == [True, False]


def test_functions_on_attributes(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(N.attrs_of(Id="x", a=None, id="y").alias("attrs"), N.attrs_of(a="1", z="<\"").alias("more"))
    pairs = lambda c: F.array_join(F.transform(c, lambda a: F.concat(a["name"], F.lit("="), F.coalesce(a["value"], F.lit("-")))), " ")
    row = df.select(
        N.index_of_key("id").alias("i"), N.index_of_key("ID", any_case=True).alias("j"), N.index_of_key("q").alias("k"), pairs(N.put_attr("a", F.lit("2"))).alias("put"), pairs(N.put_attr("n", F.lit("2"))).alias("new"),
        pairs(N.remove_attr("id", any_case=True)).alias("removed"), pairs(N.add_all_attrs("attrs", "more")).alias("added"), pairs(N.fold_keys()).alias("folded"), pairs(N.distinct_keys(any_case=True)).alias("once"),
        N.same_attrs("attrs", "attrs").alias("same"), N.attrs_html("more").alias("html"), N.joined(F.array(F.lit("a"), F.lit("b")), "-").alias("joined"), N.starts_with_newline(F.lit("\nx")).alias("newline"),
    ).first()
    assert (row.i, row.j, row.k) == (2, 0, -1) and row.put == "Id=x a=2 id=y" and row.new == "Id=x a=- id=y n=2" and row.removed == "a=-"
    assert row.added == "Id=x a=1 id=y z=<\"" and row.folded == "id=x a=- id=y" and row.once == "Id=x a=-" and row.same and row.html == " a=\"1\" z=\"<&quot;\"" and row.joined == "a-b" and row.newline


def test_list_summaries(nodes):
    from pyspark.sql import functions as F

    li = R.select(nodes, "li")
    assert [r.any for r in L.any_of(li, F.col("id") == "b").collect()] == [True] and [r.value for r in L.first_attr(li, "id").collect()] == ["a"] and [r.value for r in L.first_attr(li, "zz").collect()] == [""]
