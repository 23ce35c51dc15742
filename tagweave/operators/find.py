"""Finders by name: each is one scan of the nodes with a native predicate (or one join for text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators import select as R
from tagweave.plans.selector import Test, compile_regex


def _run(nodes: DataFrame, name: str, *args) -> DataFrame:
    every = R.elements(nodes)
    return R._Compiler(nodes).keep(Test(name, args), every, every).drop("scope", "scope_parent", "scope_eidx")


def all_elements(nodes: DataFrame) -> DataFrame:
    return _run(nodes, "all")


def by_id(nodes: DataFrame, value: str) -> DataFrame:
    """Of each page the first element with that id."""
    found = _run(nodes, "id", value)
    return found.groupBy("doc").agg(F.min_by(F.struct(*found.columns), "pre").alias("r")).select("r.*")


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return _run(nodes, "tag", tag.strip().lower())


def by_class(nodes: DataFrame, name: str) -> DataFrame:
    return _run(nodes, "class", name.lower())


def by_attribute(nodes: DataFrame, key: str) -> DataFrame:
    return _run(nodes, "attr", key.strip().lower())


def by_attribute_starting(nodes: DataFrame, prefix: str) -> DataFrame:
    return _run(nodes, "attr_prefix", prefix.strip().lower())


def by_attribute_value(nodes: DataFrame, key: str, value: str) -> DataFrame:
    return _run(nodes, "attr_eq", key.lower(), value.strip().lower())


def by_attribute_value_not(nodes: DataFrame, key: str, value: str) -> DataFrame:
    return _run(nodes, "attr_ne", key.lower(), value.strip().lower())


def by_attribute_value_starting(nodes: DataFrame, key: str, value: str) -> DataFrame:
    return _run(nodes, "attr_start", key.lower(), value.lower())


def by_attribute_value_ending(nodes: DataFrame, key: str, value: str) -> DataFrame:
    return _run(nodes, "attr_end", key.lower(), value.lower())


def by_attribute_value_containing(nodes: DataFrame, key: str, value: str) -> DataFrame:
    return _run(nodes, "attr_has", key.lower(), value.strip().lower())


def by_attribute_value_matching(nodes: DataFrame, key: str, regex: str) -> DataFrame:
    return _run(nodes, "attr_re", key.lower(), compile_regex(regex))


def by_index_less(nodes: DataFrame, n: int) -> DataFrame:
    return _run(nodes, "index", "lt", n)


def by_index_greater(nodes: DataFrame, n: int) -> DataFrame:
    return _run(nodes, "index", "gt", n)


def by_index_equals(nodes: DataFrame, n: int) -> DataFrame:
    return _run(nodes, "index", "eq", n)


def containing_text(nodes: DataFrame, needle: str) -> DataFrame:
    return _run(nodes, "text", "text", needle.lower())


def containing_own_text(nodes: DataFrame, needle: str) -> DataFrame:
    return _run(nodes, "text", "own", needle.lower())


def matching_text(nodes: DataFrame, regex: str) -> DataFrame:
    return _run(nodes, "text_re", "text", compile_regex(regex))


def matching_own_text(nodes: DataFrame, regex: str) -> DataFrame:
    return _run(nodes, "text_re", "own", compile_regex(regex))
