"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed uniform hash. A source's budget becomes a threshold on that
hash: documents below it are taken once more. The threshold is read off a histogram of
tokens by source and hash bucket; only the bucket in which the budget ends is split
again, by the next bits of the hash. Nothing is sorted, and since the hashes are fixed,
the documents of a smaller budget are always among those of a larger one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, word_count

#: Bits of hash that one level of the histogram looks at, and the number of levels.
BITS, LEVELS = 12, 3


def source_targets(sizes: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """`sizes` (source, source_size: one row a source) with `target`.

    Sources by code point, null last, get the weights in turn. Together they get
    share * all sizes by weight; where that exceeds most * source_size the target
    stops there and the rest is shared again by weight until no target is above: a
    source is full if the level of the others reaches its own ratio of room to weight.
    If no source has room left, all are full.

    The table has one row for each source, so its windows are small.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("room", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    rows = (
        rows.withColumn("full_before", F.coalesce(F.sum("room").over(upto), F.lit(0.0)))
        .withColumn("open_weight", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("open_weight"))
    )
    # passing a source that the level fills raises it, passing another lowers it: the right one is the highest
    return rows.withColumn("level", F.max("level").over(all_rows)).select(
        "source", "source_size", F.least(F.col("level") * F.col("w"), F.col("room")).alias("target")
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame, budgets: DataFrame, nearest: bool) -> DataFrame:
    """For each source (null too) the `limit` on the upper BITS*LEVELS bits of the hash
    below which its documents hold `rest` tokens, and what is then left of it.

    rows: source, size, h (those bits). budgets: source, rest. The last bucket counts
    if it fits, or with `nearest` if that comes nearer.
    """
    state = cut(budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), (F.col("rest") <= 0).alias("none")))
    for level in range(LEVELS):
        down = BITS * (LEVELS - 1 - level)
        s = small(state, 1024).alias("s")
        counts = (
            rows.alias("r")
            .join(s, _same(F.col("r.source"), F.col("s.source")) & (F.shiftright(F.col("r.h"), down + BITS) == F.col("s.prefix")))
            .groupBy("s.source", "s.rest", F.shiftright(F.col("r.h"), down).alias("bucket")).agg(F.sum("r.size").alias("n"))
        )
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        # the bucket in which the budget ends: the last one that starts at or below it
        best = (
            counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .where("below <= rest").groupBy("source").agg(F.max(F.struct("bucket", "below", "n")).alias("m")).alias("b")
        )
        prefix, left = F.col("b.m.bucket"), F.col("s.rest") - F.coalesce(F.col("b.m.below"), F.lit(0))
        if level == LEVELS - 1:  # the whole of the last bucket or none of it
            whole = F.col("b.m.n") <= left * (2 if nearest else 1)
            prefix, left = prefix + whole.cast("long"), left - F.when(whole, F.col("b.m.n")).otherwise(F.lit(0))
        state = cut(
            state.alias("s").join(best, _same(F.col("b.source"), F.col("s.source")), "left").select(
                F.col("s.source").alias("source"), left.alias("rest"), F.coalesce(prefix, F.shiftleft(F.col("s.prefix"), BITS)).alias("prefix"), "s.none"
            )
        )
    # with nothing to take, texts without words aren't taken either
    return state.select("source", "rest", F.when(F.col("none"), F.lit(0)).otherwise(F.col("prefix")).alias("limit"))


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - BITS * LEVELS)


def _planned(rows: DataFrame, share: float, weights: Sequence[float], most: float, fills: int, within: float) -> DataFrame:
    """source, source_size, target, full, steps: what is taken of each source. One row
    for each source; broadcast if they are shown to be few. rows: source, size, h."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    full = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    plan = cut(
        source_targets(sizes, share, weights, most)
        .withColumn("full", full)
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("steps", F.array().cast("array<struct<upto:double,limit:bigint>>"))
    )
    for k in range(fills + 1):
        # at first all, then, if the gap is large enough, those not taken yet that fit into it
        gap = F.when(F.col("p.rest") > F.lit(float(within)) * F.col("p.target"), F.col("p.rest")).otherwise(F.lit(-1.0)) if k else F.lit(float("inf"))
        open_rows = (
            rows.alias("r").join(small(plan, 1024).alias("p"), _same(F.col("r.source"), F.col("p.source")))
            .where(~_taken(F.col("r.size"), F.col("r.h"), F.col("p.steps")) & (F.col("r.size") <= gap))
            .select("r.source", "r.size", "r.h")
        )
        limits = thresholds(open_rows, plan.select("source", "rest"), nearest=k == fills)
        step = F.array(F.struct(gap.alias("upto"), F.col("l.limit").alias("limit")))
        plan = cut(
            plan.alias("p").join(limits.alias("l"), _same(F.col("p.source"), F.col("l.source")))
            .select("p.source", "p.source_size", "p.target", "p.full", "l.rest", F.concat("p.steps", step).alias("steps"))
        )
    return small(plan, 1024)


def _copies(size: Column, h: Column, most: float) -> Column:
    return F.least(F.col("p.full") + _taken(size, h, F.col("p.steps")).cast("long"), F.lit(math.ceil(most)).cast("long"))


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    return cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(seed).alias("h")))


def mix(
    docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0, fills: int = 2, within: float = 0.002, seed: int = 7
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of `docs`.

    size: words of the text (null or empty: 0). copies: how often the mix takes the
    document, 0 to ceil(most); taken: size times copies. A document at the threshold
    may be long; where the gap that it leaves is more than `within` of the target, it is
    filled, `fills` times over, from those behind the threshold that are no longer than
    the gap, by a threshold of their own. Without such a fill (large sources, or fills=0)
    the mixes of rising budgets are nested. Rows equal in id and text
    share one hash and one decision. Null sources form one source. An empty table
    gives no rows; other columns are not looked at. Reruns agree.
    """
    rows = _rows(docs, seed)
    plan = _planned(rows, share, weights, most, fills, within)
    copies = _copies(F.col("r.size"), F.col("r.h"), most)
    return (
        rows.alias("r").join(plan.alias("p"), _same(F.col("r.source"), F.col("p.source")))
        .select("r.doc_id", "r.size", "p.source_size", "p.target", (F.col("r.size") * copies).alias("taken"), copies.alias("copies"))
    )


def mix_documents(
    docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0, fills: int = 2, within: float = 0.002, seed: int = 7
) -> DataFrame:
    """The rows of `docs`, all columns, each as often as mix() takes it."""
    plan = _planned(_rows(docs, seed), share, weights, most, fills, within)
    copies = _copies(word_count(F.col("r.row")["text"]), F.col("r.h"), most)
    # a row travels as one struct, so that no column of it, whatever its name is, meets one of this function's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _hash(seed).alias("h"))
    return (
        rows.alias("r").join(plan.alias("p"), _same(F.col("r.row")["source"], F.col("p.source")))
        .select("r.row", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))).alias("copy"))
        .select("row.*")
    )


def _taken(size: Column, h: Column, steps: Column) -> Column:
    return F.exists(steps, lambda s: (size <= s["upto"]) & (h < s["limit"]))
