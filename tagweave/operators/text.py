"""Text of elements from the relation of nodes, without leaving the JVM.

What an element's text consists of is one stretch of its page's text: the page's pieces are put together once
in document order, and an element's text is cut out of that by offsets, which one running sum for each page
yields. So elements inside one another cost no more than others. White space is normalised in the pieces, once for each
page, and not in what is cut out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.parse import KEPT

# order of what happens at one place: nodes end, inner ones first, then an element's text begins, then nodes are entered
_LEAVE, _BEGIN, _ENTER = 0, 1, 2


def _events(nodes: DataFrame, kind: str) -> DataFrame:
    """(doc, parent, at, rank, tie, s): pieces of text with their places in the order of the page."""
    c = F.col
    event = lambda at, rank, s: F.struct(at.alias("at"), F.lit(rank).alias("rank"), s.alias("s"))
    if kind in ("text", "own"):
        enter = F.when(c("piece").isNotNull(), event(c("pre"), _ENTER, c("piece")))
        before = F.when(c("space_before") if kind == "text" else c("tag") == "br", event(c("pre"), _ENTER, F.lit(" ")))
        after = F.when(c("space_after") & F.lit(kind == "text"), event(c("end"), _LEAVE, F.lit(" ")))
        rows = nodes.select("doc", "parent", "pre", F.inline(F.array_compact(F.array(enter, before, after))))
    else:
        kinds = "kind in ('text', 'cdata') or tag = 'br'" if kind != "data" else "kind in ('data', 'comment', 'cdata')"
        piece = F.when(c("tag") == "br", "\n").otherwise(c("value"))
        rows = nodes.where(kinds).select("doc", "parent", "pre", c("pre").alias("at"), F.lit(_ENTER).alias("rank"), piece.alias("s"))
    return rows.withColumn("tie", -2 * c("pre")).drop("pre")


def _string(pieces: Column) -> Column:
    return F.array_join(F.sort_array(pieces)["s"], "")


def _single(s: Column) -> Column:
    """Single spaces; a kept space at the end of a piece stands for the space that would part it from the next."""
    s = F.when(s.contains("  "), F.regexp_replace(s, " +", " ")).otherwise(s)
    return F.replace(s, F.lit(KEPT[0x20] + " "), F.lit(KEPT[0x20]))


def _plain(s: Column) -> Column:
    """White space that was kept, as it stands."""
    return F.when(s.rlike(f"[{''.join(KEPT.values())}]"), F.translate(s, "".join(KEPT.values()), "".join(map(chr, KEPT)))).otherwise(s)


def _trimmed(s: Column) -> Column:
    return F.btrim(s, F.lit(" \t\n\f\r"))


def _below(nodes: DataFrame, tops: DataFrame, kind: str) -> DataFrame:
    """(doc, pre, text): all pieces below each of ``tops`` (doc, pre, end)."""
    c, none = F.col, F.lit(None)
    pieces = _events(nodes, kind).drop("parent").join(tops.select("doc").distinct(), "doc", "left_semi").withColumns({"mark": F.lit(0), "top": none.cast("int")})
    begin = tops.select("doc", c("pre").alias("at"), F.lit(_BEGIN).alias("rank"), F.lit("").alias("s"), F.lit(0).alias("tie"), F.lit(1).alias("mark"), c("pre").alias("top"))
    finish = tops.select("doc", c("end").alias("at"), F.lit(_LEAVE).alias("rank"), F.lit("").alias("s"), (1 - 2 * c("pre")).alias("tie"), F.lit(2).alias("mark"), c("pre").alias("top"))
    order = Window.partitionBy("doc").orderBy("at", "rank", "tie")
    rows = pieces.unionByName(begin).unionByName(finish)
    if kind == "text":  # of spaces that meet where pieces do one stays
        rows = rows.withColumn("s", _single(c("s")))
        last = F.last(F.when(c("s") != "", F.substr("s", F.lit(-1))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("last", last).withColumn("s", _plain(F.when(c("s").startswith(" ") & c("last").isin(" ", KEPT[0x20]), F.substr("s", F.lit(2))).otherwise(c("s"))))
    rows = rows.withColumn("sum", F.sum(F.octet_length("s")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    page = rows.groupBy("doc").agg(
        _string(F.collect_list(F.when(c("mark") == 0, F.struct("at", "rank", "tie", "s")))).cast("binary").alias("whole"),
        F.sort_array(F.collect_list(F.when(c("mark") > 0, F.struct("top", "mark", "sum")))).alias("marks"),
    )

    def cut(whole: Column, k: Column) -> Column:  # by bytes: characters would be counted from the beginning of the page each time
        a, b = F.get("marks", k)["sum"], F.get("marks", k + 1)["sum"]
        return F.struct(F.get("marks", k)["top"].alias("pre"), F.substr(whole, (a + 1).cast("int"), (b - a).cast("int")).cast("string").alias("text"))

    # as the variable of a function the page's text isn't copied for each cut
    cuts = F.transform(F.array("whole"), lambda whole: F.transform(F.sequence(F.lit(0), F.size("marks") - 2, F.lit(2)), lambda k: cut(whole, k)))
    return page.select("doc", F.inline(F.get(cuts, F.lit(0))))


def texts(nodes: DataFrame, roots: DataFrame, kind: str = "text") -> DataFrame:
    """(doc, pre, text) of the elements ``roots`` (doc, pre); of those without any text it may be missing.

    kind: ``text`` (all below, normalised), ``own`` (direct children), ``whole`` and ``whole_own`` (as
    they stand), ``data`` (scripts, styles and comments below).
    """
    if kind in ("own", "whole_own"):
        tops = roots.select("doc", F.col("pre").alias("parent")).distinct()
        children = _events(nodes, kind).join(tops, ["doc", "parent"], "left_semi")
        out = children.groupBy("doc", F.col("parent").alias("pre")).agg(_string(F.collect_list(F.struct("at", "rank", "tie", "s"))).alias("text"))
    else:
        tops = roots.select("doc", "pre", "end").distinct() if "end" in roots.columns else nodes.select("doc", "pre", "end").join(roots.select("doc", "pre").distinct(), ["doc", "pre"], "left_semi")
        out = _below(nodes, tops, kind)
    if kind not in ("text", "own"):
        return out
    text = F.col("text") if kind == "text" else _plain(_single(F.col("text")))
    return out.withColumn("text", _trimmed(text))


def with_text(nodes: DataFrame, found: DataFrame, kind: str = "text", name: str = "text") -> DataFrame:
    """``found`` elements with their text as a column; "" where there is none."""
    t = texts(nodes, found, kind).select("doc", "pre", F.col("text").alias("__t"))
    return found.join(t, ["doc", "pre"], "left").withColumn(name, F.coalesce("__t", F.lit(""))).drop("__t")
