"""Operators on lists of elements: rows of the relation of nodes, ordered by ``pre`` within a page (``doc``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions import strings as N
from tagweave.operators import select as R
from tagweave.operators import text as RT

_AT = ["doc", "pre"]


def _elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element'")


def _of(found: DataFrame) -> DataFrame:
    return found.select("doc", *(F.col(c).alias(f"o_{c}") for c in ("pre", "end", "parent", "eidx")))


def _related(nodes: DataFrame, found: DataFrame, on: Column, css: str | None = None, distinct: bool = True) -> DataFrame:
    if distinct:  # a semi join returns an element once; whole rows made distinct are sorted and shuffled again
        out = R.joined_once(_elements(nodes), _of(found), on)
    else:
        out = _elements(nodes).join(_of(found), "doc").where(on).drop("o_end", "o_parent", "o_eidx")
    return out.join(R.select(nodes, css).select(*_AT), _AT, "left_semi") if css else out


def next_sibling(nodes: DataFrame, found: DataFrame, css: str | None = None) -> DataFrame:
    return _related(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("eidx") == F.col("o_eidx") + 1), css)


def prev_sibling(nodes: DataFrame, found: DataFrame, css: str | None = None) -> DataFrame:
    return _related(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("eidx") == F.col("o_eidx") - 1), css)


def next_all(nodes: DataFrame, found: DataFrame, css: str | None = None) -> DataFrame:
    """Following siblings of each element; repeated where elements are siblings, with o_pre for the order."""
    return _related(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("eidx") > F.col("o_eidx")), css, False)


def prev_all(nodes: DataFrame, found: DataFrame, css: str | None = None) -> DataFrame:
    return _related(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("eidx") < F.col("o_eidx")), css, False)


def siblings(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _related(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("pre") != F.col("o_pre")))


def parents(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """All ancestors, each once."""
    return _related(nodes, found, (F.col("pre") < F.col("o_pre")) & (F.col("o_pre") < F.col("end")))


def parent(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _related(nodes, found, F.col("pre") == F.col("o_parent"))


def children(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _related(nodes, found, F.col("parent") == F.col("o_pre"))


def closest(nodes: DataFrame, found: DataFrame, css: str) -> DataFrame:
    """Of each element itself or its nearest ancestor that matches; o_pre is the element."""
    match = R.select(nodes, css)
    pairs = match.join(_of(found), "doc").where((F.col("pre") <= F.col("o_pre")) & (F.col("o_pre") < F.col("end")))
    names = match.columns
    return pairs.groupBy("doc", "o_pre").agg(F.max_by(F.struct(*names), "pre").alias("r")).select("o_pre", "r.*")


def matching(nodes: DataFrame, found: DataFrame, css: str) -> DataFrame:
    return found.join(R.select(nodes, css).select(*_AT), _AT, "left_semi")


def not_matching(nodes: DataFrame, found: DataFrame, css: str) -> DataFrame:
    return found.join(R.select(nodes, css).select(*_AT), _AT, "left_anti")


def eq(found: DataFrame, index: int) -> DataFrame:
    """Of each page's list the element at an index from 0."""
    return found.withColumn("__n", F.row_number().over(Window.partitionBy("doc").orderBy("pre"))).where(F.col("__n") == index + 1).drop("__n")


def first(found: DataFrame) -> DataFrame:
    return found.groupBy("doc").agg(F.min_by(F.struct(*found.columns), "pre").alias("r")).select("r.*")


def last(found: DataFrame) -> DataFrame:
    return found.groupBy("doc").agg(F.max_by(F.struct(*found.columns), "pre").alias("r")).select("r.*")


def each_attr(found: DataFrame, name: str) -> DataFrame:
    """(page_id, values): the attribute of the elements that have it, in order."""
    have = found.where(N.has_attr(name)).select("doc", "page_id", F.struct("pre", N.attr(name).alias("v")).alias("x"))
    return have.groupBy("doc", "page_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("values")).drop("doc")


def each_text(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, values): the text of the elements that have any, in order."""
    t = RT.with_text(nodes, found, name="__text").where("__text <> ''").select("doc", "page_id", F.struct("pre", F.col("__text").alias("text")).alias("x"))
    return t.groupBy("doc", "page_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]).alias("values")).drop("doc")


def joined_text(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, text): the texts of a page's list joined by a space."""
    return each_text(nodes, found).select("page_id", F.array_join("values", " ").alias("text"))


def retain(found: DataFrame, others: DataFrame) -> DataFrame:
    """Those that are among others."""
    return found.join(others.select(*_AT).distinct(), _AT, "left_semi")


def remove_all(found: DataFrame, others: DataFrame) -> DataFrame:
    """Those that are not among others."""
    return found.join(others.select(*_AT).distinct(), _AT, "left_anti")


def remove_if(found: DataFrame, condition: Column) -> DataFrame:
    """Those for which a condition doesn't hold."""
    return found.where(~F.coalesce(condition, F.lit(False)))


def any_of(found: DataFrame, condition: Column) -> DataFrame:
    """(page_id, any): of each page's list whether some element meets a condition."""
    return found.groupBy("doc", "page_id").agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias("any")).drop("doc")


def first_attr(found: DataFrame, name: str) -> DataFrame:
    """(page_id, value): of each page's list the attribute of the first element that has it; "" if none has."""
    value = N.attr(name)
    return found.groupBy("doc", "page_id").agg(F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col("pre"))), F.lit("")).alias("value")).drop("doc")


def value(nodes: DataFrame, found: DataFrame, name: str = "value") -> DataFrame:
    """``found`` with what form controls hold: the text of a ``textarea``, else the attribute ``value`` or ""."""
    areas = RT.with_text(nodes, found.where("tag = 'textarea'"), "whole", name)
    rest = found.where("tag <> 'textarea'").withColumn(name, F.coalesce(N.attr("value"), F.lit("")))
    return rest.unionByName(areas)


def has_class(found: DataFrame, name: str) -> DataFrame:
    return found.where(F.array_contains("classes", name.lower()))


def has_attr(found: DataFrame, name: str) -> DataFrame:
    return found.where(N.has_attr(name))
