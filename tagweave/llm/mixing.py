"""Mixing sources to target weights by hierarchical budgets (operator 4).

Documents are leaves' tokens in a tree of levels (domain, language, source). A total budget flows from
the root: each node's budget is split among its children by weight, no child getting more than its
subtree holds in ``max_epochs`` epochs. What one child cannot take goes to its siblings by weight; only
what a whole family cannot take has been kept from it one level up, where its parent's siblings get it.

A leaf's budget is used in seeded epochs: whole epochs first, then of the next epoch, whose order is a
hash of seed, epoch and document, the prefix that fills the budget. The end of the prefix is found by
sums over ranges of the hash, each 256 times narrower than the last, and by exact order in the last.

Defined results: null levels count as empty names; null tokens count as 0; documents without tokens are
never taken; rows with the same ``doc_id`` in a leaf have the same place in the order, and share what is
left when the prefix ends with them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm import common

LEVELS = ("domain", "lang", "source")
#: The tree of budgets is worked out in the driver; it has one leaf for each combination of levels.
MOST_LEAVES = 1_000_000


def split_budget(budget: float, capacity: Sequence[float], weight: Sequence[float]) -> list[float]:
    """Shares of a budget by weight, no more than each capacity; what one cannot take the others get."""
    out, left = [0.0] * len(capacity), min(float(budget), float(sum(capacity)))
    open_ = [k for k in range(len(capacity)) if capacity[k] > 0]
    while open_ and left > 0:
        total = sum(weight[k] for k in open_)
        share = {k: left * (weight[k] / total if total > 0 else 1 / len(open_)) for k in open_}
        full = [k for k in open_ if share[k] >= capacity[k]]
        if not full:
            for k in open_:
                out[k] = share[k]
            break
        for k in full:
            out[k], left = float(capacity[k]), left - capacity[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def leaf_budgets(tokens: dict[tuple, int], weights: Sequence[dict], budget: int, max_epochs: int, default: float = 1.0) -> dict[tuple, int]:
    """Whole-token budgets of leaves (paths of level values) from tokens by leaf and weights by level. They sum
    to the budget, or to all that there is: what rounding down leaves goes to the largest fractions."""
    exact: dict[tuple, float] = {}

    def go(paths: list[tuple], level: int, budget: float) -> None:
        if level == len(paths[0]):
            exact[paths[0]] = min(budget, float(tokens[paths[0]] * max_epochs))
            return
        children: dict = {}
        for p in paths:
            children.setdefault(p[level], []).append(p)
        names = sorted(children)
        capacity = [max_epochs * sum(tokens[p] for p in children[n]) for n in names]
        for n, b in zip(names, split_budget(budget, capacity, [weights[level].get(n, default) for n in names]), strict=True):
            go(children[n], level + 1, b)

    if tokens:
        go(sorted(tokens), 0, float(budget))
    out = {p: int(b + 1e-6) for p, b in exact.items()}
    left = min(int(budget), max_epochs * sum(tokens.values())) - sum(out.values())
    for p in sorted(exact, key=lambda p: (out[p] - exact[p], p)):
        if left > 0 and out[p] < tokens[p] * max_epochs:
            out[p], left = out[p] + 1, left - 1
    return out


def word_count(text: str = "text") -> Column:
    """Words between blanks, the measure of tokens where no other is given."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def domain_of(source: str = "source", domains: int = 4) -> Column:
    """A source's domain where the table has none: by the number that ends its name."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("domain"), F.when(number == "", 0).otherwise(F.pmod(number.cast("int"), F.lit(domains))).cast("string"))


def plan(docs: DataFrame, levels: dict[str, Column], tokens: Column, weights: Sequence[dict], budget: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(leaf plan, rows): of each leaf its budget, whole epochs, and where the prefix of the next epoch ends.

    ``budget``: tokens, or below 1 a share of all tokens. ``rows`` are key columns without texts.
    """
    names = list(levels)
    rows = common.materialise(docs.select("doc_id", *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")), "mix-rows")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("t"))
    held = {tuple(r[n] for n in names): r["t"] for r in leaves.limit(MOST_LEAVES + 1).collect()}
    if len(held) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    total = sum(held.values())
    budgets = leaf_budgets(held, weights, int(budget if budget >= 1 else budget * total), max_epochs)
    spark = docs.sparkSession
    data = [(*p, held[p], b, b // held[p] if held[p] else 0, b % held[p] if held[p] else 0) for p, b in budgets.items()]
    ddl = ", ".join(f"{n} string" for n in names) + ", leaf_tokens bigint, budget bigint, epochs bigint, rest bigint"
    leaf = spark.createDataFrame(data, ddl)
    # the hash in the order of unsigned numbers, as it is cut into ever narrower ranges
    partial = rows.where("tokens > 0").join(F.broadcast(leaf.where("rest > 0")), names)
    cut = common.materialise(partial.select(*names, "doc_id", "tokens", "rest", order_key(seed, F.col("epochs")).alias("h")), "mix-order")
    done = leaf.where("rest > 0").select(*names, F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("before"))
    for bits in (8, 16, 24):
        here = cut.join(F.broadcast(done.withColumnRenamed("range", "outer")), names).where(F.shiftright("h", 63 - bits + 8) == F.col("outer"))
        sums = here.groupBy(*names, F.shiftright("h", 63 - bits).alias("range")).agg(F.sum("tokens").alias("t"), F.first("before").alias("start"), F.first("rest").alias("rest"))
        upto = F.sum("t").over(Window.partitionBy(*names).orderBy("range")) + F.col("start")
        edge = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("t") < F.col("rest")))
        done = common.materialise(edge.select(*names, "range", (F.col("upto") - F.col("t")).alias("before")), "mix-range")
    last = cut.join(F.broadcast(done), names).where(F.shiftright("h", 63 - 24) == F.col("range"))
    docs_in = last.groupBy(*names, "h", F.col("doc_id").alias("end_id")).agg(F.sum("tokens").alias("t"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy(*names).orderBy("h", "end_id")) + F.col("before")
    ends = docs_in.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("t") < F.col("rest")))
    ends = ends.select(*names, F.col("h").alias("end_h"), "end_id", (F.col("rest") - F.col("upto") + F.col("t")).alias("end_take"), F.col("t").alias("end_tokens"))
    return leaf.join(common.materialise(ends, "mix-ends"), names, "left"), rows


def order_key(seed: int, epoch: Column) -> Column:
    """A document's place in a leaf's epoch: 63 bits of a hash of seed, epoch and id."""
    return F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("doc_id")).bitwiseAND(F.lit((1 << 63) - 1))


def select(docs: DataFrame, levels: dict[str, Column], tokens: Column, leaf_plan: DataFrame, seed: int) -> DataFrame:
    """``docs`` with epoch and take (tokens of the document in that epoch), a row for each epoch that takes
    it. The leaf plan is broadcast: it has a row for each leaf. Texts are neither shuffled nor copied."""
    names = {n: f"__level_{k}" for k, n in enumerate(levels)}
    right = leaf_plan.select(*(F.col(n).alias(m) for n, m in names.items()), F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), F.col("end_h").alias("__h"), F.col("end_id").alias("__id"), F.col("end_take").alias("__take"), F.col("end_tokens").alias("__sum"))
    left = docs.drop("epoch", "take").select("*", *(F.coalesce(c.cast("string"), F.lit("")).alias(names[n]) for n, c in levels.items()), F.coalesce(tokens, F.lit(0)).cast("long").alias("__tokens"))
    both = left.where("__tokens > 0").join(F.broadcast(right), list(names.values()))
    h, end = order_key(seed, F.col("__epochs")), F.col("__h")
    doc_first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    end_first = F.coalesce(F.col("__id"), F.lit(-(1 << 63)))
    at_end = (h == end) & (doc_first == end_first)
    before = (h < end) | ((h == end) & (doc_first < end_first))
    part = F.when(F.col("__rest") == 0, 0).when(before, F.col("__tokens")).when(at_end, F.floor(F.col("__take") * F.col("__tokens") / F.col("__sum"))).otherwise(0)
    whole = F.when(F.col("__epochs") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__epochs") - 1, F.lit(0))), lambda e: F.struct(e.alias("epoch"), F.col("__tokens").alias("take"))))
    taken = F.concat(F.coalesce(whole, F.array().cast("array<struct<epoch:bigint,take:bigint>>")), F.array(F.struct(F.col("__epochs").alias("epoch"), part.cast("long").alias("take"))))
    out = both.withColumn("__take_all", F.explode(F.filter(taken, lambda x: x["take"] > 0)))
    return out.select(*(c for c in docs.columns if c not in ("epoch", "take")), "__take_all.epoch", "__take_all.take")


def mix(docs: DataFrame, levels: dict[str, Column], weights: Sequence[dict], budget: float = 0.5, tokens: Column | None = None, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """Select documents to target weights; see the module."""
    tokens = word_count() if tokens is None else tokens
    leaf_plan, _ = plan(docs, levels, tokens, weights, budget, max_epochs, seed)
    return select(docs, levels, tokens, leaf_plan, seed)


# Production parameters of the query and of the pipeline's stage.
WEIGHTS = ({"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1}, {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}, {})


def default_levels() -> dict[str, Column]:
    return {"domain": domain_of(), "lang": F.col("lang"), "source": F.col("source")}
