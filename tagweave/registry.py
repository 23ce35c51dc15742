"""Queries over the driver's tables, and their SQL over the raw markup where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave import store
from tagweave.functions import strings as N
from tagweave.functions.urls import resolve_url
from tagweave.operators import find
from tagweave.operators import lists as L
from tagweave.operators import navigate as V
from tagweave.operators import pages as P
from tagweave.operators import select as R
from tagweave.operators import text as RT
from tagweave.operators.parse import parse_errors, parse_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


_parsed: dict[tuple[str, str], DataFrame] = {}


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the pages, parsed and written to the shared folder once in a session: selectors and
    texts scan them several times, with the columns that each needs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _parsed:
        _parsed[key] = store.materialise(parse_pages(pages_of(spark, sf_dir)), "nodes")
    return _parsed[key]


def _sql_text(column: str) -> str:
    """Text of markup without tags: references decoded, white space as one space."""
    out = column
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{sign}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')"


# What the template of the pages shows to a regular expression: links, list items and the like stand in it
# without markup inside, so the SQL sees the same.
_LINKS = """SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label,
unnest(generate_series(1, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS n FROM pages"""
_HOST = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@query(f"SELECT page_id, n::INT AS ord, label AS text, {_HOST} || href AS href FROM ({_LINKS})")
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every navigation link, absolute."""
    nodes = nodes_of(spark, sf_dir)
    found = RT.with_text(nodes, R.select(nodes, "nav li a[href]"))
    order = F.row_number().over(Window.partitionBy("doc").orderBy("pre"))
    return found.select("page_id", order.alias("ord"), "text", resolve_url("base_uri", N.attr("href")).alias("href"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_links(spark, sf_dir)


def _matches(css: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = nodes_of(spark, sf_dir)
        return RT.with_text(nodes, R.select(nodes, css)).select("page_id", "text")

    return run


def _selector(name: str, css: str, where: str) -> None:
    """A selector over navigation links; the SQL is a condition on links with their number n of m."""
    QUERIES[name] = _matches(css)
    ORACLE_SQL[name] = f"SELECT page_id, label AS text FROM (SELECT *, max(n) OVER (PARTITION BY page_id) AS m FROM ({_LINKS})) links WHERE {where}"


_selector("select_attr_start", "a[href^=/th]", "lower(href) LIKE '/th%'")
_selector("select_attr_end", "a[href$='.']", "href LIKE '%.'")
_selector("select_attr_contains", "a[href*=ou]", "lower(href) LIKE '%ou%'")
_selector("select_attr_regex", "a[href~=^/[a-d]]", "regexp_matches(href, '^/[a-d]')")
_selector("select_attr_not", "a[href!=/the]", "lower(href) <> '/the'")
_selector("select_index_eq", "nav li:eq(1) a", "n = 2")
_selector("select_index_lt", "nav li:lt(2) a", "n <= 2")
_selector("select_index_gt", "nav li:gt(2) a", "n > 3")
_selector("select_nth_even", "nav li:nth-child(2n) a", "n % 2 = 0")
_selector("select_first_child", "nav li:first-child a", "n = 1")
_selector("select_not_first", "nav li:not(:first-child) a", "n > 1")
_selector("select_next_sibling", "nav li + li a", "n > 1")
_selector("select_later_sibling", "nav li:eq(0) ~ li a", "n > 1")
_selector("select_has", "nav li:has(a[href^=/th]) > a", "lower(href) LIKE '/th%'")
_selector("select_contains", "nav a:contains(th)", "contains(lower(label), 'th')")
_selector("select_matches", "nav a:matches(^[A-Z])", "regexp_matches(label, '^[A-Z]')")
_selector("select_union", "nav a[href^=/th], nav li:eq(0) > a", "lower(href) LIKE '/th%' OR n = 1")
_selector("select_is", "nav :is(li:first-child, li:last-child, p) > a", "n = 1 OR n = m")
_selector("select_last_child", "nav li:last-child > a", "n = m")
_selector("select_nth_last_child", "nav li:nth-last-child(2) a", "n = m - 1")
_selector("select_nth_of_type", "li:nth-of-type(3n+1) a", "n % 3 = 1")
_selector("select_last_of_type", "ul > li:last-of-type a", "n = m")
_selector("select_first_of_type", "ul > li:first-of-type a", "n = 1")
_selector("select_nth_last_of_type", "ul > li:nth-last-of-type(odd) a", "(m - n) % 2 = 0")
_selector("select_only_child", "li:eq(3) > a:only-child", "n = 4")
_selector("select_only_of_type", "li:eq(4) > a:only-of-type", "n = 5")
_selector("select_matches_own", "nav a:matchesOwn(^[a-m].*[a-m]$)", "regexp_matches(label, '^[a-m].*[a-m]$')")
_selector("select_whole_text", "nav a:containsWholeText(Th)", "contains(label, 'Th')")
_selector("select_whole_own_text", "nav a:containsWholeOwnText(ti)", "contains(label, 'ti')")
_selector("select_contains_own", "nav a:containsOwn(EN)", "contains(lower(label), 'en')")
_selector("select_absolute", "nav a[abs:href^=https]", "starts_with(url, 'https')")
_selector("select_has_sibling", "nav li:has(+ li:has(a[href^=/th])) > a", "EXISTS (SELECT 1 FROM (" + _LINKS + ") o WHERE o.page_id = links.page_id AND o.n = links.n + 1 AND lower(o.href) LIKE '/th%')")
_selector("select_not_has", "nav li:not(:has(a[href*=e])) > a", "lower(href) NOT LIKE '%e%'")
_selector("select_attr_value", "nav a[href='/de']", "lower(href) = '/de'")
_selector("select_sibling_chain", "nav li:first-child + li + li a", "n = 3")
_selector("select_nested_not", "nav li:not(:first-child):not(:last-child) a", "n > 1 AND n < m")


@query(f"SELECT page_id, {_sql_text("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages WHERE regexp_matches(html, '<title>[^<]*</title>')")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.titles(nodes_of(spark, sf_dir))


@query(f"SELECT page_id, {_sql_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS text FROM pages WHERE regexp_matches(html, '<h1>[^<]*</h1>')")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches("article:has(h1) > h1")(spark, sf_dir)


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.select(nodes_of(spark, sf_dir), "html:root[lang]")
    return found.select("page_id", N.attr("lang").alias("lang"))


@query(f"SELECT page_id, {_sql_text("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS text FROM pages WHERE regexp_matches(html, '<div class=.ad.>[^<]*</div>')")
def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return RT.with_text(nodes, R.select(nodes, "div.ad"), "own").select("page_id", "text")


@query("SELECT page_id, regexp_extract(html, '<script>([^<]*</p>[^<]*)</script>', 1) AS data FROM pages WHERE regexp_matches(html, '<script>[^<]*</p>[^<]*</script>')")
def script_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return RT.with_text(nodes, R.select(nodes, "head script"), "data", "data").select("page_id", "data")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) AS comment FROM pages")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(spark, sf_dir).where("kind = 'comment'").select("page_id", F.col("value").alias("comment"))


@query(f"SELECT {_HOST} AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM ({_LINKS}) GROUP BY 1")
def links_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused: parsed, selected and counted without the nodes in between."""
    host = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    found = P.counts_of(pages_of(spark, sf_dir), "nav a[href]").where("n > 0")
    return found.groupBy(host.alias("host")).agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


@query(f"SELECT page_id, string_agg(label, ' ' ORDER BY n) AS text FROM ({_LINKS}) GROUP BY 1")
def list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return L.joined_text(nodes, R.select(nodes, "nav a"))


@query(f"SELECT page_id, string_agg(href, ' ' ORDER BY n) AS hrefs FROM ({_LINKS}) GROUP BY 1")
def list_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.select(nodes_of(spark, sf_dir), "nav a")
    return L.each_attr(found, "href").select("page_id", F.array_join("values", " ").alias("hrefs"))


@query(f"SELECT page_id, label AS text FROM (SELECT *, max(n) OVER (PARTITION BY page_id) AS m FROM ({_LINKS})) WHERE n = 2")
def list_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    after = L.next_sibling(nodes, R.select(nodes, "nav li:first-child"), ":has(a)")
    return RT.with_text(nodes, after).select("page_id", "text")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\f\\r ]+', ' ', 'g'), ' ') AS text FROM documents")
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.trim(N.normalise_whitespace(F.col("text"))).alias("text"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents")
def text_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", N.escape_text(F.col("text")).alias("text"))


@query("SELECT doc_id, NOT regexp_matches(text, '[^ \\t\\n\\f\\r]') AS blank, regexp_full_match(text, '[0-9]+') AS digits FROM documents")
def text_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", N.is_blank(t).alias("blank"), N.is_numeric(t).alias("digits"))


@query()
def nodes_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(spark, sf_dir)


@query("SELECT page_id, " + ", ".join(f'NULL::VARCHAR AS "{name}"' for name in P.METADATA) + f""", {_sql_text("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS "htmlTitle" FROM pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.metadata(nodes_of(spark, sf_dir))


@query()
def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sanitise(pages_of(spark, sf_dir), "relaxed")


@query()
def serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.serialise(pages_of(spark, sf_dir))


@query()
def pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.serialise(pages_of(spark, sf_dir), pretty=True)


@query()
def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.edit(pages_of(spark, sf_dir), "div.ad", "remove")


@query()
def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stream_elements(pages_of(spark, sf_dir))


@query()
def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_errors(pages_of(spark, sf_dir))


@query("SELECT page_id, 0 AS form, 0 AS ord, url AS action, 'get' AS method, '' AS name, '' AS value FROM pages WHERE regexp_matches(html, '<(input|select|textarea)')")
def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.form_data(pages_of(spark, sf_dir))


def _finder(name: str, where: str, run) -> None:
    """A finder over navigation links, as ``_selector``."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = nodes_of(spark, sf_dir)
        return RT.with_text(nodes, run(nodes).where("tag = 'a'")).select("page_id", "text")

    QUERIES[name] = build
    ORACLE_SQL[name] = f"SELECT page_id, label AS text FROM (SELECT *, max(n) OVER (PARTITION BY page_id) AS m FROM ({_LINKS})) links WHERE {where}"


_finder("find_attribute_value", "lower(href) = '/the'", lambda n: find.by_attribute_value(n, "href", "/the"))
_finder("find_attribute_ending", "lower(href) LIKE '%on'", lambda n: find.by_attribute_value_ending(n, "href", "on"))
_finder("find_attribute_matching", "regexp_matches(href, 'n.$')", lambda n: find.by_attribute_value_matching(n, "href", "n.$"))
_finder("find_own_text", "contains(lower(label), 'an')", lambda n: find.containing_own_text(n, "an"))
_finder("find_matching_text", "regexp_matches(label, '[.,]$')", lambda n: find.matching_text(n, "[.,]$"))
_finder("navigate_child", "n = 2", lambda n: V.child(n, V.child(n, R.select(n, "nav > ul"), 1), 0))
_finder("navigate_last_child", "n = m", lambda n: V.child(n, V.child(n, R.select(n, "nav > ul"), -1), 0))
_finder("navigate_subtree", "n = 3", lambda n: V.subtree(n, R.select(n, "nav li:eq(2)"), "element"))
_finder("find_index_less", "n <= 2", lambda n: V.child(n, find.by_index_less(n, 2).where("tag = 'li'"), 0))
_finder("find_index_greater", "n > 4", lambda n: V.child(n, find.by_index_greater(n, 3).where("tag = 'li'"), 0))
_finder("find_index_equals", "n = 5", lambda n: V.child(n, find.by_index_equals(n, 4).where("tag = 'li'"), 0))
_finder("find_attribute_value_not", "lower(href) <> '/the'", lambda n: find.by_attribute_value_not(n, "href", "/the"))
_finder("find_attribute_starting_value", "lower(href) LIKE '/in%'", lambda n: find.by_attribute_value_starting(n, "href", "/in"))
_finder("find_attribute_containing", "lower(href) LIKE '%er%'", lambda n: find.by_attribute_value_containing(n, "href", "er"))
_finder("find_containing_text", "contains(lower(label), 'st')", lambda n: find.containing_text(n, "st"))
_finder("find_matching_own_text", "regexp_matches(label, '^.{1,3}$')", lambda n: find.matching_own_text(n, "^.{1,3}$"))
_finder("list_next_all", "n > 1", lambda n: V.child(n, L.next_all(n, R.select(n, "nav li:first-child")), 0))
_finder("list_prev", "n = m - 1", lambda n: V.child(n, L.prev_sibling(n, R.select(n, "nav li:last-child")), 0))
_finder("list_prev_all", "n < 4", lambda n: V.child(n, L.prev_all(n, R.select(n, "nav li:eq(3)")), 0))
_finder("list_siblings", "n <> 3", lambda n: V.child(n, L.siblings(n, R.select(n, "nav li:eq(2)")), 0))
_finder("list_eq", "n = 4", lambda n: L.eq(R.select(n, "nav a"), 3))
_finder("list_first", "n = 1", lambda n: L.first(R.select(n, "nav a")))
_finder("list_last", "n = m", lambda n: L.last(R.select(n, "nav a")))
_finder("list_not", "n <> 2", lambda n: V.child(n, L.not_matching(n, R.select(n, "nav li"), ":eq(1)"), 0))
_finder("list_matching", "lower(href) LIKE '/th%'", lambda n: L.matching(n, R.select(n, "nav a"), "[href^=/th]"))
_finder("list_children", "n % 2 = 1", lambda n: L.children(n, R.select(n, "nav li:nth-child(odd)")))
_finder("list_parent", "n = 2", lambda n: V.child(n, L.parent(n, R.select(n, "nav li:eq(1) > a")), 0))
_finder("list_retain", "n IN (1, 2)", lambda n: L.retain(R.select(n, "nav a"), R.select(n, "li:lt(2) a")))
_finder("list_remove_if", "length(href) <= 5", lambda n: L.remove_if(R.select(n, "nav a"), F.length(N.attr("href")) > 5))
_finder("list_closest", "n = 3", lambda n: V.child(n, L.closest(n, R.select(n, "nav li:eq(2) a"), "li").drop("o_pre"), 0))
_finder("navigate_next_node", "n = 2", lambda n: V.child(n, V.next_node(n, R.select(n, "nav li:first-child")), 0))
_finder("navigate_prev_node", "n = m - 1", lambda n: V.child(n, V.prev_node(n, R.select(n, "nav li:last-child")), 0))
_finder("navigate_first_sibling", "n = 1", lambda n: V.child(n, V.first_sibling(n, R.select(n, "nav li:eq(3)")), 0))
_finder("navigate_last_sibling", "n = m", lambda n: V.child(n, V.last_sibling(n, R.select(n, "nav li:eq(1)")), 0))
_finder("navigate_sibling_nodes", "n <> 2", lambda n: V.child(n, V.sibling_nodes(n, R.select(n, "nav li:eq(1)")), 0))
_finder("select_within", "n = 3", lambda n: R.select_within(n, R.select(n, "nav ul"), "> li:eq(2) > a"))


# Paragraphs in the SQL: what follows each <p>, up to its end tag or to the next. <b> is opened in them and never closed.
_ENDED = r"regexp_replace(html, '<[^<>]*$', '')"
_DECODED = lambda c: _sql_text(f"regexp_replace({c}, '&(amp|copy|quot)$', '&\\1;')")
_PARAGRAPHS = f"""SELECT page_id, k, max(k) OVER (PARTITION BY page_id) AS m, split_part(replace(piece, '</article>', '</p>'), '</p>', 1) AS piece FROM (
SELECT page_id, unnest(string_split({_ENDED}, '<p>')[2:]) AS piece, unnest(generate_series(1, len(string_split({_ENDED}, '<p>')) - 1)) AS k FROM pages)"""
_PARAGRAPH_TEXT = _DECODED("regexp_replace(piece, '<[^>]*>', ' ', 'g')")


def _paragraphs(name: str, css: str, where: str) -> None:
    QUERIES[name] = _matches(css)
    ORACLE_SQL[name] = f"SELECT page_id, {_PARAGRAPH_TEXT} AS text FROM ({_PARAGRAPHS}) WHERE {where}"


_paragraphs("select_tag", "article p", "true")
_paragraphs("select_child", "article > p:nth-child(2)", "k = 1")
_paragraphs("paragraphs_first", "p:first-of-type", "k = 1")
_paragraphs("paragraphs_last", "article p:last-of-type", "k = m")
_paragraphs("paragraphs_between", "article > p ~ p:not(:last-of-type)", "k > 1 AND k < m")
_paragraphs("paragraphs_broken", "p:has(> b br)", "contains(piece, '<br')")
_paragraphs("paragraphs_about", "article p:contains(tion):not(:contains(the))", f"contains(lower({_PARAGRAPH_TEXT}), 'tion') AND NOT contains(lower({_PARAGRAPH_TEXT}), 'the')")
_paragraphs("bold_paragraphs", "article p > b", "true")
_paragraphs("select_no_match", "article p#none", "false")


@query(f"SELECT page_id, count(*) AS paragraphs, sum(length({_PARAGRAPH_TEXT}))::BIGINT AS letters FROM ({_PARAGRAPHS}) GROUP BY 1")
def paragraph_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    found = RT.with_text(nodes, find.by_tag(nodes, "P"))
    return found.groupBy("doc", "page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("letters")).drop("doc")


# An open <b> is opened again in each later paragraph, three times at most, and in the footer.
_BOLD = f"""SELECT page_id, sum(least(before, 3) + own)::BIGINT + CASE WHEN any_value(foot) THEN least(sum(own), 3) ELSE 0 END::BIGINT AS n FROM (
SELECT page_id, k, own, coalesce(sum(own) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, foot FROM (
SELECT p.page_id, k, (len(string_split(piece, '<b>')) - 1) AS own, regexp_matches(html, '<footer>[^<]') AS foot FROM ({_PARAGRAPHS}) p JOIN pages USING (page_id))) GROUP BY 1"""


@query(f"SELECT page_id, n::BIGINT AS n FROM ({_BOLD})")
def bold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often formatting left open is opened."""
    found = find.by_tag(nodes_of(spark, sf_dir), "b")
    return found.groupBy("doc", "page_id").agg(F.count("*").alias("n")).drop("doc")


@query(f"SELECT page_id, {_sql_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS text FROM pages WHERE regexp_matches(html, '<h1>[^<]*</h1>')")
def find_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return RT.with_text(nodes, find.by_tag(nodes, "H1")).select("page_id", "text")


_AD = f"SELECT page_id, {_sql_text("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS text FROM pages WHERE regexp_matches(html, '<div class=.ad.>[^<]*</div>')"


@query(_AD)
def find_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return RT.with_text(nodes, find.by_attribute(nodes, "CLASS")).select("page_id", "text")


@query(_AD)
def find_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return RT.with_text(nodes, find.by_class(nodes, "Ad"), "whole_own").select("page_id", F.trim(N.normalise_whitespace(F.col("text"))).alias("text"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def find_attribute_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.by_attribute_starting(nodes_of(spark, sf_dir), "la").select("page_id", N.attr("lang").alias("lang"))


@query("SELECT page_id, 'meta' AS tag FROM pages")
def select_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select(nodes_of(spark, sf_dir), "head :empty").select("page_id", "tag")


@query("SELECT page_id, unnest(['style', 'script']) AS tag FROM pages")
def select_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select(nodes_of(spark, sf_dir), "head :containsData(track), head :containsData(margin)").where("tag in ('style', 'script')").select("page_id", "tag")


@query(f"SELECT page_id, {_sql_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS text FROM pages WHERE regexp_matches(html, '<h1>[^<]*</h1>')")
def navigate_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return V.text_nodes(nodes, R.select(nodes, "h1")).select("page_id", F.trim(N.normalise_whitespace(F.col("value"))).alias("text"))


@query(f"SELECT page_id, unnest(['html', 'body', 'nav', 'ul']) AS tag, 1::BIGINT AS n FROM pages UNION ALL SELECT page_id, 'li', count(*) FROM ({_LINKS}) GROUP BY 1")
def list_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return L.parents(nodes, R.select(nodes, "nav a")).groupBy("doc", "page_id", "tag").agg(F.count("*").alias("n")).drop("doc")


@query("""SELECT page_id, unnest(['doctype', 'comment', 'data', 'document']) AS kind, unnest([1, len(regexp_extract_all(html, '<!--.*?-->')), 2, 1])::BIGINT AS n FROM pages""")
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes_of(spark, sf_dir).where("kind in ('doctype', 'comment', 'data', 'document')")
    return found.groupBy("doc", "page_id", "kind").agg(F.count("*").alias("n")).drop("doc")


_BODY = f"regexp_replace(regexp_replace({_ENDED}, '^.*?</head>', '', 's'), '<!--.*?-->', '', 'g')"


@query(f"SELECT page_id, {_DECODED(f"regexp_replace({_BODY}, '<[^>]*>', ' ', 'g')")} AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of each page's body."""
    nodes = nodes_of(spark, sf_dir)
    return RT.with_text(nodes, R.select(nodes, "html > body")).select("page_id", "text")


_ESCAPED = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PLAIN = f"regexp_replace(regexp_replace({_BODY}, '<[^>]*>', '', 'g'), '&(amp|copy|quot)$', '&\\1;')"
for _name, _sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    _PLAIN = f"replace({_PLAIN}, '&{_name};', '{_sign}')"


@query(f"SELECT page_id, {_ESCAPED(_PLAIN)} AS html FROM pages")
def sanitised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strictest safelist leaves."""
    return P.sanitise(pages_of(spark, sf_dir), "none").select("page_id", "html")


@query("SELECT page_id, length(replace(regexp_extract(html, '<div class=.ad.>[^<]*</div>'), '&quot;', '\"'))::INT AS removed FROM pages")
def edited_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much shorter the markup is without the advertisement."""
    before, after = P.serialise(pages_of(spark, sf_dir)), P.edit(pages_of(spark, sf_dir), "div.ad", "remove")
    return before.select("page_id", F.length("html").alias("a")).join(after.select("page_id", F.length("html").alias("b")), "page_id").select("page_id", (F.col("a") - F.col("b")).alias("removed"))


@query(f"SELECT page_id, url AS location, 'html' AS doctype, false AS quirks, 'utf-8' AS charset, {_sql_text("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(pages_of(spark, sf_dir)).select("page_id", "location", "doctype", "quirks", "charset", "title")


@query(f"SELECT page_id, {_PARAGRAPH_TEXT} AS text FROM ({_PARAGRAPHS}) WHERE k = 1")
def streamed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraph to be complete; no page is read further."""
    return P.select_streaming(pages_of(spark, sf_dir), "article p").select("page_id", "text")


@query(f"""SELECT page_id, tag, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS ord FROM (SELECT page_id, 'title' AS tag, 0 AS place FROM pages UNION ALL SELECT page_id, 'h1', 1000 FROM pages
UNION ALL SELECT page_id, unnest(['a', 'li']), unnest([2 * n, 2 * n + 1]) FROM ({_LINKS}))""")
def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which links, their items and headings are complete."""
    found = P.stream_elements(pages_of(spark, sf_dir)).where("tag in ('title', 'a', 'li', 'h1')")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("emit_ord")) - 1
    return found.select("page_id", "tag", order.alias("ord"))


@query("SELECT page_id, (len(string_split(html, '<p>')) - 1 + 1)::BIGINT AS n FROM pages WHERE html LIKE '%</html>'")
def page_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of pages that aren't cut off: each paragraph, and the footer, ends with a <b> left open."""
    whole = pages_of(spark, sf_dir).where("html like '%</html>'")
    return parse_errors(whole).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {_DECODED(f"regexp_replace(regexp_replace({_BODY}, '<nav>.*?</nav>|<div class=.ad.>[^<]*</div>', ' ', 'gs'), '<[^>]*>', ' ', 'g')")} AS text FROM pages")
def filtered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of what a filtering walk leaves."""
    left = P.filter_pages(pages_of(spark, sf_dir), [("nav", "remove"), (".ad", "remove")])
    return P.select_pages(left.withColumn("url", F.lit("")), "html > body").select("page_id", "text")


@query("SELECT page_id, (2 * len(regexp_extract_all(html, '<li>')))::BIGINT AS n FROM pages")
def visit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items met on the way in and out of each page."""
    return P.visits(pages_of(spark, sf_dir)).where("node = 'li'").groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, count(*) AS n FROM ({_LINKS}) GROUP BY 1")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counts_of(pages_of(spark, sf_dir), "nav li > a[href]").select("page_id", "n")


@query(f"SELECT page_id, (n - 1)::INT AS ord, 'html > body > nav > ul > li:nth-child(' || n || ') > a' AS selector FROM ({_LINKS})")
def element_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.css_selectors(pages_of(spark, sf_dir), "nav a")
