"""Ordered groups cut into blocks, so that one large group is dealt over many tasks.

A window over a whole group sorts it in one task. Where a row only looks a bounded way to either side, each
block is a window of its own, to which the rows that its first and last ones look at are added
from the blocks beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and the blocks of a group at most.
ROWS, BLOCKS = 50_000, 1024


def with_blocks(df: DataFrame, by: list[str], value: str, rows: int = ROWS) -> DataFrame:
    """`df` with _block: a whole number that never falls along `value` within a group, equal for
    equal values. Groups are cut at quantiles into blocks of about `rows` rows, one for a small
    group; the table of cuts has a row for each group and is joined, whatever its size."""
    steps = F.lit([i / BLOCKS for i in range(1, BLOCKS)])
    n = F.least(F.ceil(F.count("*") / rows), F.lit(BLOCKS))
    groups = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.when(n > 1, F.percentile_approx(value, steps, 10 * BLOCKS)).alias("_at"), n.alias("_n"))
    # every (BLOCKS / n)-th of the quantiles
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.get("_at", (F.floor(i * BLOCKS / F.col("_n")) - 1).cast("int"))))
    groups = groups.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.when(F.col("_n") > 1, cuts).alias("_cuts"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return df.join(groups, same, "left").withColumn("_block", F.coalesce(F.when(F.col("_cuts").isNotNull(), below), F.lit(0))).drop("_cuts", *[f"_by{i}" for i in range(len(by))])


def with_borders(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Rows of with_blocks() and, flagged _border, for each block the k rows before its first and behind its
    last one, from whatever blocks they lie in. Only the k outermost rows of either end of each block are looked through for them."""
    own = df.withColumn("_border", F.lit(False))
    row = F.struct(*[c for c in df.columns if c != "_block"])
    out = own
    for forward in (True, False):
        directed = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
        back = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
        # the k rows of a block that lie nearest to the blocks that look back on it
        ends = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*back))).where(F.col("_k") <= k)
        near = Window.partitionBy(*by).orderBy(F.col("_block").asc() if forward else F.col("_block").desc(), *directed)
        before = F.collect_list(row).over(near.rowsBetween(-k, -1))
        n = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*directed))
        first = ends.withColumn("_rows", before).withColumn("_first", n).where("_first = 1").select("_block", F.explode("_rows").alias("_row"))
        out = out.unionByName(first.select("_row.*", "_block", F.lit(True).alias("_border")))
    return out


def time_block(time: Column, seconds: int) -> Column:
    """Number of the stretch of time, `seconds` long."""
    return F.floor(time / seconds).cast("long")
