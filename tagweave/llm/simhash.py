"""SimHash document fingerprints with DataFrame functions only (operator 2).

Terms are the runs of three words of a text (shorter texts: the whole). A term's weight is its number of
characters, at most ``HEAVIEST``, once for every occurrence; 64 bits of its hash vote for or against each
bit of the fingerprint. Two counts share one long, so 32 sums make a fingerprint in one aggregation
that combines before it shuffles.

``near_fingerprints`` finds every pair of fingerprints within a radius by permuted block tables: within
``radius`` bits two fingerprints agree in one of ``radius + 1`` blocks, and a table for each block holds
them by that block; an overfull table entry is split by blocks of its remaining bits.

``with_next`` brings each document its successor in descending ``doc_id`` order without a global sort:
rows are dealt into cells of about equal numbers, cut at quantiles of id and hash of the text, and the first
document of a cell is also sent, as a guest, to the end of the cell before. So neither outlying ids nor
one id or null that many rows share make a large cell.

Defined results: null text counts as empty; a text without words has fingerprint zero; rows with the
same ``doc_id`` follow each other in order of a hash of their texts; null ids come last; of a single row
it is its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm import common

HEAVIEST = 63  # a count has 32 bits; with this weight it holds a text of 68 million words
CELL_ROWS = 50_000
_LOW = 0xFFFFFFFF
_LANES = 0x0000000100000001


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fp (a long) of each row; rows are told apart by their keys."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")), " ")
    split = texts.select(*keys, words.alias("__w"))
    zipped = split.select(*keys, F.posexplode(F.arrays_zip(F.col("__w").alias("w0"), F.slice("__w", 2, F.size("__w")).alias("w1"), F.slice("__w", 3, F.size("__w")).alias("w2"))).alias("__at", "__t"))
    full = zipped.where((F.col("__at") == 0) | F.col("__t.w2").isNotNull())
    length = F.length("__t.w0") + F.coalesce(F.length("__t.w1"), F.lit(0)) + F.coalesce(F.length("__t.w2"), F.lit(0))
    voting = full.select(*keys, F.xxhash64("__t.w0", "__t.w1", "__t.w2").alias("__h"), F.least(length, F.lit(HEAVIEST)).cast("long").alias("__n"))
    sums = [F.sum(F.shiftrightunsigned("__h", b).bitwiseAND(F.lit(_LANES)) * F.col("__n")).alias(f"__s{b}") for b in range(32)]
    votes = voting.groupBy(*keys).agg(F.sum("__n").alias("__all"), *sums)
    fp = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"__s{b}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"__s{b}", 32)
        for bit, count in ((b, low), (b + 32, high)):
            fp = fp.bitwiseOR(F.when(2 * count > F.col("__all"), F.lit((1 << bit) - (1 << 64) * (bit == 63))).otherwise(F.lit(0)).cast("long"))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_fingerprints(nodes: DataFrame, radius: int = 3, split: int = 2000) -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints, a < b, of a table ``fp`` within ``radius`` bits."""
    from tagweave.llm.bktree import shards

    dealt = shards(nodes.select("fp", F.col("fp").alias("node")).distinct(), radius, split)
    left = dealt.select("tab", "key", F.col("fp").alias("a"))
    right = dealt.select("tab", "key", F.col("fp").alias("b"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return left.join(right, ["tab", "key"]).where((F.col("a") < F.col("b")) & (distance <= radius)).select("a", "b", distance.alias("distance")).distinct()


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), cell, rank, next_text, next_cell and next_rank: the successor in
    descending ``doc_id`` order; after the last document comes the first."""
    spark = docs.sparkSession
    # in ascending order of these: descending ids, nulls last, then hashes of texts
    order = [F.col("doc_id").isNull().cast("long"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), F.xxhash64("text")]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", *(c.alias(f"o{k}") for k, c in enumerate(order)))
    parts, n = int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count()
    cells = max(4 * parts, -(-n // CELL_ROWS))
    keys = docs.select("o0", "o1", "o2").repartitionByRange(cells, "o0", "o1", "o2")
    heads = sorted(tuple(r.head) for r in keys.groupBy(F.spark_partition_id().alias("cell")).agg(F.min(F.struct("o0", "o1", "o2")).alias("head")).collect())  # one for each cell
    key, bounds = F.struct("o0", "o1", "o2"), [F.lit([h[k] for h in heads] or [0]).cast("array<bigint>") for k in range(3)]
    head = lambda k: F.struct(*(F.get(b, k).alias(f"o{j}") for j, b in enumerate(bounds)))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        upper = (middle > acc["low"]) & (head(middle) <= key)
        return F.struct(F.when(upper, middle).otherwise(acc["low"]).alias("low"), F.when(upper, acc["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, len(heads)).bit_length() + 1))
    home = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(max(1, len(heads))).alias("high")), halve, lambda acc: acc["low"])
    placed = docs.withColumn("home", home.cast("long"))
    is_head = head(F.col("home").cast("int")) == key
    before = F.when(F.col("home") > 0, F.col("home") - 1).otherwise(F.lit(max(0, len(heads) - 1))).cast("long")
    own = F.struct(F.col("home").alias("cell"), F.lit(0).alias("late"))
    places = F.when(is_head, F.array(own, F.struct(before.alias("cell"), F.lit(1).alias("late")))).otherwise(F.array(own))
    rows = placed.select("doc_id", "text", "o0", "o1", "o2", "home", F.inline(places)).repartition(max(parts, cells // 4), "cell")
    order = Window.partitionBy("cell").orderBy("late", "o0", "o1", "o2")
    out = rows.select(
        "doc_id", "text", "cell", "late", F.row_number().over(order).cast("long").alias("rank"),
        F.lead("text").over(order).alias("next_text"), F.lead("home").over(order).alias("next_cell"), F.lead("late").over(order).alias("next_late"),
    ).where("late = 0")
    return out.withColumn("next_rank", F.when(F.col("next_late") == 1, 1).otherwise(F.col("rank") + 1)).drop("late", "next_late")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next text."""
    both = with_next(docs).withColumn("edited", F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, length(text) div 2)")))
    keys = ["cell", "rank", "doc_id", "n_chars", "edited_sha256", "next_cell", "next_rank", "kind"]
    wide = both.select(
        "cell", "rank", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "next_cell", "next_rank",
        F.posexplode(F.array("text", "edited")).alias("kind", "body"),
    )
    prints = fingerprints(wide, keys, "body")
    rows = prints.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    rows = common.materialise(rows, "simhash")
    follow = rows.select(F.col("cell").alias("next_cell"), F.col("rank").alias("next_rank"), F.col("fp").alias("nfp"))
    out = rows.join(follow, ["next_cell", "next_rank"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexadecimal(F.col("fp")).alias("fingerprint"), hexadecimal(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
