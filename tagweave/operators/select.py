"""Selectors over the relation of nodes.

A plan becomes predicates, and for each combinator a semi join on equal keys (child, sibling) or one pass
over a page's rows in document order (descendant, ``:has``); nothing is collected, no pairs of nodes are
made, and a selector without combinators is one scan with a filter. Only ``:has`` around combinators of
its own makes the pairs of an element with what is below it. Rows of a page meet on ``doc``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions import strings as N
from tagweave.functions.urls import resolve_url
from tagweave.operators import text as X
from tagweave.plans import selector as S

_KEY = ["doc", "scope", "pre"]


def _column(name: str, args: tuple) -> Column | None:
    """A predicate that needs the element's row alone; ``None`` if it needs text."""
    c = F.col
    if name == "tag":
        return c("tag") == args[0]
    if name == "all":
        return F.lit(True)
    if name == "tag_ns":
        return c("tag").startswith(args[1]) if args[0] == "prefix" else (c("tag") == args[1]) | c("tag").endswith(":" + args[1])
    if name == "id":
        return F.coalesce(c("id") == args[0], F.lit(False))
    if name == "class":
        return F.array_contains("classes", args[0])
    if name == "attr_prefix":
        return F.exists("attrs", lambda a: F.lower(a["name"]).startswith(args[0]))
    if name == "attr" or name.startswith("attr_"):
        key = args[0]
        value = N.attr(key)
        if key.startswith("abs:"):
            value = F.nullif(resolve_url(F.col("base_uri"), N.attr(key[4:])), F.lit(""))
        if name == "attr":
            return value.isNotNull()
        low = F.lower(value)
        test = {
            "attr_eq": lambda: F.trim(low) == args[1], "attr_ne": lambda: F.coalesce(low, F.lit("")) != args[1], "attr_start": lambda: low.startswith(args[1]),
            "attr_end": lambda: low.endswith(args[1]), "attr_has": lambda: low.contains(args[1]), "attr_re": lambda: value.rlike(args[1]),
        }[name]()
        return F.coalesce(test, F.lit(False))
    if name == "index":
        return {"eq": c("eidx") == args[1], "gt": c("eidx") > args[1], "lt": (c("eidx") < args[1]) & (c("pre") != c("scope"))}[args[0]]
    if name == "nth":
        last, of_type, step, offset = args
        place = (c("tcount") - c("tidx") + 1 if last else c("tidx")) if of_type else (c("ecount") - c("eidx") if last else c("eidx") + 1)
        hit = place == offset if step == 0 else ((place - offset) * step >= 0) & (F.pmod(place - offset, F.lit(abs(step))) == 0)
        return hit & (c("depth") > 1)
    if name == "root":
        return F.when(c("scope") == 0, (c("depth") == 1) & (c("eidx") == 0)).otherwise(c("pre") == c("scope"))
    if name == "scope":
        return c("pre") == c("scope")
    if name == "empty":
        return c("empty")
    return None


def predicate(plan) -> Column | None:
    """The plan as one predicate, if it has no combinator and needs no text."""
    if isinstance(plan, S.Test):
        return _column(plan.name, plan.args)
    if isinstance(plan, S.All | S.Any):
        parts = [predicate(p) for p in plan.parts]
        if any(p is None for p in parts):
            return None
        return reduce((lambda a, b: a & b) if isinstance(plan, S.All) else (lambda a, b: a | b), parts)
    if isinstance(plan, S.Not | S.Is):
        inner = predicate(plan.inner)
        return inner if inner is None or isinstance(plan, S.Is) else ~inner
    return None


def _inside(frame: DataFrame, left: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``frame`` below one of ``left``. Intervals are nested or apart, so one that holds a node is
    the one that reaches farthest of all that begin before it: a running maximum tells."""
    begun = Window.partitionBy(*by).orderBy("pre").rangeBetween(Window.unboundedPreceding, -1)
    marks = left.select(*by, "pre", F.col("end").alias("__reach"))
    rows = frame.withColumn("__own", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    return rows.withColumn("__far", F.max("__reach").over(begun)).where("__own and __far > pre").drop("__reach", "__own", "__far")


def with_below(frame: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of ``frame`` that have one of ``marks`` below them: the next of these comes before their end."""
    later = Window.partitionBy("doc").orderBy(F.desc("pre")).rangeBetween(Window.unboundedPreceding, -1)
    found = marks.select("doc", "pre", F.col("pre").alias("__mark")).distinct()
    rows = frame.withColumn("__own", F.lit(True)).unionByName(found, allowMissingColumns=True)
    return rows.withColumn("__next", F.min("__mark").over(later)).where("__own and __next < end").drop("__mark", "__own", "__next")


def joined_once(nodes: DataFrame, found: DataFrame, on: Column) -> DataFrame:
    """Rows of ``nodes`` for which a row of ``found`` of their page meets ``on``, each once."""
    return nodes.join(found.withColumnRenamed("doc", "o_doc"), (F.col("doc") == F.col("o_doc")) & on, "left_semi")


class _Compiler:
    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    def keep(self, plan, frame: DataFrame, universe: DataFrame) -> DataFrame:
        """Rows of ``frame`` that match; ``universe`` has all elements of each scope."""
        if (p := predicate(plan)) is not None:
            return frame.where(p)
        if isinstance(plan, S.All):
            plain = sorted(plan.parts, key=lambda p: (predicate(p) is None, S.cost(p)))
            return reduce(lambda f, p: self.keep(p, f, universe), plain, frame)
        if isinstance(plan, S.Any):
            found = [self.keep(p, frame, universe).select(*_KEY) for p in plan.parts]
            return frame.join(reduce(DataFrame.unionByName, found).distinct(), _KEY, "left_semi")
        if isinstance(plan, S.Is):
            return self.keep(plan.inner, frame, universe)
        if isinstance(plan, S.Not):
            return frame.join(self.keep(plan.inner, frame, universe).select(*_KEY), _KEY, "left_anti")
        if isinstance(plan, S.Related):
            return self.related(plan, frame, universe)
        if isinstance(plan, S.Has):
            return self.has(plan, frame)
        return self.by_text(plan, frame)

    def related(self, plan: S.Related, frame: DataFrame, universe: DataFrame) -> DataFrame:
        c = F.col
        if plan.left == S.Test("scope"):
            return frame.where({
                "ancestor": c("pre") != c("scope"), "parent": (c("parent") == c("scope")) & (c("pre") != c("scope")),
                "before": (c("parent") == c("scope_parent")) & (c("eidx") > c("scope_eidx")), "previous": (c("parent") == c("scope_parent")) & (c("eidx") == c("scope_eidx") + 1),
            }[plan.how])
        left, frame = self.keep(plan.left, universe, universe), frame.where("pre <> scope")
        if plan.how == "ancestor":
            return _inside(frame, left, ["doc", "scope"])
        if plan.how == "parent":
            return frame.join(left.select("doc", "scope", c("pre").alias("parent")), ["doc", "scope", "parent"], "left_semi")
        left = left.where(c("parent").isNotNull())
        if plan.how == "previous":
            return frame.join(left.select("doc", "scope", "parent", (c("eidx") + 1).alias("eidx")), ["doc", "scope", "parent", "eidx"], "left_semi")
        first = left.groupBy("doc", "scope", "parent").agg(F.min("eidx").alias("__first"))
        return frame.join(first, ["doc", "scope", "parent"]).where(c("eidx") > c("__first")).drop("__first").select(*frame.columns)

    def has(self, plan: S.Has, frame: DataFrame) -> DataFrame:
        c, simple = F.col, S.one_relation(plan.inner)
        if simple is not None:
            how, inner = simple
            marks = self.keep(inner, every := elements(self.nodes), every)
            if how == "ancestor":
                return with_below(frame, marks)
            if how == "parent":
                return frame.join(marks.select("doc", c("parent").alias("pre")), ["doc", "pre"], "left_semi")
            if how == "previous":
                return frame.join(marks.select("doc", "parent", (c("eidx") - 1).alias("eidx")), ["doc", "parent", "eidx"], "left_semi")
            last = marks.groupBy("doc", "parent").agg(F.max("eidx").alias("__last"))
            return frame.join(last, ["doc", "parent"]).where(c("eidx") < c("__last")).drop("__last").select(*frame.columns)
        tops = frame.select("doc", c("pre").alias("s_pre"), c("end").alias("s_end"), c("parent").alias("s_parent"), c("eidx").alias("s_eidx")).distinct()
        below = elements(self.nodes).drop("scope", "scope_parent", "scope_eidx")
        inside = (c("pre") >= c("s_pre")) & (c("pre") < c("s_end"))
        near = inside | (c("parent") == c("s_parent")) if plan.sibling else inside
        pairs = below.join(tops, "doc").where(near)
        universe = pairs.withColumnsRenamed({"s_pre": "scope", "s_parent": "scope_parent", "s_eidx": "scope_eidx"})
        candidates = universe.where("pre > scope") if plan.sibling else universe.where("pre <> scope")
        found = self.keep(plan.inner, candidates.drop("s_end"), universe.drop("s_end")).select("doc", c("scope").alias("pre")).distinct()
        return frame.join(found, ["doc", "pre"], "left_semi")

    def by_text(self, plan: S.Test, frame: DataFrame) -> DataFrame:
        if plan.name == "match_text":
            raise S.SelectorError("':matchText' finds elements that are made of texts; select_pages does so")
        kind, needle = plan.args

        def test(found: Column) -> Column:
            if plan.name == "text_re":
                return found.rlike(needle)
            return (F.lower(found) if kind in ("text", "own", "data") else found).contains(needle)

        # tested before the join, so that it is an answer and no text that is joined
        texts = X.texts(self.nodes, frame.select("doc", "pre", "end").distinct(), kind).select("doc", "pre", test(F.col("text")).alias("__hit"))
        return frame.join(texts, ["doc", "pre"], "left").where(F.coalesce("__hit", test(F.lit("")))).drop("__hit")


def elements(nodes: DataFrame) -> DataFrame:
    """Elements with the document as scope."""
    none = F.lit(None).cast("int")
    return nodes.where("kind = 'element'").withColumns({"scope": F.lit(0), "scope_parent": none, "scope_eidx": none})


def select(nodes: DataFrame, css: str) -> DataFrame:
    """Rows of the elements that match ``css``; document order is ``pre``."""
    compiler, every = _Compiler(nodes), elements(nodes)
    return compiler.keep(S.parse(css), every, every).drop("scope", "scope_parent", "scope_eidx")


def select_within(nodes: DataFrame, roots: DataFrame, css: str) -> DataFrame:
    """As ``select`` below and at each of the elements ``roots``; an element is returned once."""
    tops = roots.select("doc", F.col("pre").alias("scope"), F.col("end").alias("s_end"), F.col("parent").alias("scope_parent"), F.col("eidx").alias("scope_eidx"))
    below = nodes.where("kind = 'element'").join(tops, "doc").where("pre >= scope and pre < s_end").drop("s_end")
    found = _Compiler(nodes).keep(S.parse(css), below, below)
    return found.drop("scope", "scope_parent", "scope_eidx").dropDuplicates(["doc", "pre"])


def select_first(nodes: DataFrame, css: str) -> DataFrame:
    """Of each page the first match."""
    found = select(nodes, css)
    names = found.columns
    best = found.groupBy("doc").agg(F.min_by(F.struct(*names), "pre").alias("row"))
    return best.select("row.*")
