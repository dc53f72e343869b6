"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


ROWS_PER_PART = 20_000


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of `links` (u, v: long).

    Alternates two steps until nothing changes: each node hands its larger neighbours
    to its smallest one (large star), then its smaller ones (small star). The number
    of rounds grows with the logarithm of the longest chain. Each round is two sums by
    key and two equi-joins, whose hot keys Spark splits; it is written to the
    checkpoint folder, in as few partitions as its links fill. Links of a node to itself and repeated links are allowed; links
    with a null end are left out. No links give no rows.
    """
    e = cut(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(e)
    # links only become fewer: a small graph needs few tasks and files
    parts = max(1, -(-mark[0] // ROWS_PER_PART))
    while mark[0]:
        e = e.coalesce(parts)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts)
        )
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
