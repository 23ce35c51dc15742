"""From nodes to nodes, of any kind: equality joins on page (``doc``), parent and place among siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators import select as R

from tagweave.operators import select as R


def _join(nodes: DataFrame, found: DataFrame, on) -> DataFrame:
    return R.joined_once(nodes, found.select("doc", *(F.col(c).alias(f"o_{c}") for c in ("pre", "end", "parent", "sib_idx", "eidx"))), on)


def child_nodes(nodes: DataFrame, found: DataFrame, *kinds: str) -> DataFrame:
    """Direct children, of the given kinds if any are."""
    out = _join(nodes, found, F.col("parent") == F.col("o_pre"))
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def text_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return child_nodes(nodes, found, "text", "cdata")


def data_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return child_nodes(nodes, found, "data")


def comment_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return child_nodes(nodes, found, "comment")


def child_node(nodes: DataFrame, found: DataFrame, index: int) -> DataFrame:
    return _join(nodes, found, (F.col("parent") == F.col("o_pre")) & (F.col("sib_idx") == index))


def child(nodes: DataFrame, found: DataFrame, index: int) -> DataFrame:
    """The element child at an index from 0; from the end if it is negative."""
    place = F.col("eidx") == index if index >= 0 else F.col("eidx") == F.col("ecount") + index
    return _join(nodes, found, (F.col("parent") == F.col("o_pre")) & place)


def next_node(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _join(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("sib_idx") == F.col("o_sib_idx") + 1))


def prev_node(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _join(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("sib_idx") == F.col("o_sib_idx") - 1))


def sibling_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _join(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("pre") != F.col("o_pre")))


def first_sibling(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The first element of each element's parent."""
    return _join(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("eidx") == 0))


def last_sibling(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _join(nodes, found, (F.col("parent") == F.col("o_parent")) & (F.col("eidx") == F.col("ecount") - 1))


def subtree(nodes: DataFrame, found: DataFrame, *kinds: str) -> DataFrame:
    """The nodes themselves and all below, of the given kinds if any are."""
    out = _join(nodes, found, (F.col("pre") >= F.col("o_pre")) & (F.col("pre") < F.col("o_end")))
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent < 0")


def has_text(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Those with any text that is not blank below them."""
    return R.with_below(found, nodes.where("kind in ('text', 'cdata')").where(F.col("value").rlike("[^ \\t\\n\\f\\r]")))
