"""Sharding by a hypergeometric communication matrix.

A uniform random shuffle that deals N rows into S shards of exact sizes without ever
sorting the whole table: (1) every input partition permutes its rows locally; (2) the
counts that a uniform shuffle would send from each partition to each shard are drawn
from the multivariate hypergeometric law, one row of the matrix for each partition;
(3) each partition deals its permuted rows by these counts; (4) each shard permutes
what it received. All work on rows is DataFrame code. Only the matrix, a few whole
numbers for each partition, is drawn by the driver; the partitions are coalesced to
at most MAX_BLOCKS first, which bounds it.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut

#: At most so many partitions take part in the matrix; more are coalesced.
MAX_BLOCKS = 20_000
#: A task of the second permutation is meant to sort about so many rows.
ROWS_PER_TASK = 250_000

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def hypergeometric(rng: random.Random, total: int, good: int, drawn: int) -> int:
    """How many of `drawn` rows, taken from `total` without putting back, are among
    `good` of them. Inversion outward from the mode: about one standard deviation of
    steps, exact up to double rounding, for any size."""
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    if low == high:
        return low
    f = lambda n: math.lgamma(n + 1)
    bad = total - good
    up = down = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    p_up = p_down = math.exp(
        f(good) - f(up) - f(good - up) + f(bad) - f(drawn - up) - f(bad - drawn + up) - f(total) + f(drawn) + f(total - drawn)
    )
    u = rng.random() - p_up
    mode = up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(sizes: Sequence[int], room: Sequence[int], seed: int) -> Iterator[list[int]]:
    """For each partition size, how many of its rows go to each shard. `room` are the
    exact shard sizes; both sum to the same number. Every matrix with these margins
    comes with the probability that it has under a uniform shuffle."""
    rng = random.Random(seed)
    left, total = list(room), sum(room)
    for size in sizes:
        row, todo, pool = [], size, total
        for s, free in enumerate(left):
            k = hypergeometric(rng, pool, free, todo) if todo else 0
            row.append(k)
            pool -= free
            todo -= k
            left[s] = free - k
        total -= size
        yield row


def shard_rows(df: DataFrame, shards: int, seed: int = 20, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """`df` with `shard` (0 to shards-1) and `slot` (gapless from 0 within the shard).

    Shard sizes differ by one at most; every assignment with these sizes is equally
    likely, so equal texts, hot sources and copies spread evenly. The same input files
    and settings give the same result.

    Nulls in any column and repeated rows are ordinary rows. An empty table gives no
    rows; with fewer rows than shards the last shards are empty. Columns of `df` that
    are named like the two results are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    mixed = rows.coalesce(MAX_BLOCKS).sortWithinPartitions(F.xxhash64(F.lit(seed), F.to_json(F.col("row"))))
    at = F.monotonically_increasing_id()
    local = cut(
        mixed.select("row", at.alias("at")).select(
            "row", F.shiftright("at", _ROW_BITS).alias("block"), F.col("at").bitwiseAND((1 << _ROW_BITS) - 1).alias("rank")
        )
    )

    sizes = sorted((r["block"], r["count"]) for r in local.groupBy("block").count().collect())
    n = sum(k for _, k in sizes)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    cuts = []
    for (block, _), row in zip(sizes, communication_matrix([k for _, k in sizes], room, seed), strict=True):
        total, bounds = 0, []
        for k in row:
            total += k
            bounds.append(total)
        cuts.append((block, bounds))
    matrix = spark.createDataFrame(cuts, "block long, bounds array<long>")
    if len(cuts) * (shards + 2) * 8 <= BROADCAST_BYTES:
        matrix = F.broadcast(matrix)

    # the second permutation: shard, then a hash of the row's place, in ranges that tasks can sort
    tasks = max(8, -(-n // (shards * ROWS_PER_TASK)))
    dealt = (
        local.join(matrix, "block")
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("rank"))))
        .withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "block", "rank"), 32))
        .withColumn("range", F.shiftright(F.col("draw") * F.lit(tasks), 32))
        .select("row", "shard", "range", "draw", "block", "rank")
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
        .select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    if shards * tasks * 16 <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    place = F.row_number().over(Window.partitionBy("shard", "range").orderBy("draw", "block", "rank")) - 1
    return (
        dealt.withColumn("place", place)
        .join(starts, ["shard", "range"])
        .select("row.*", F.col("shard").alias("__shard"), (F.col("start") + F.col("place")).cast("long").alias("__slot"))
        .withColumnsRenamed({"__shard": shard, "__slot": slot})
    )


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """For each document its shard and slot with size and checksum, without the text.

    size: UTF-8 bytes of the text (null: none) plus 16; text_crc32 is null for a null
    text. Documents with equal texts are dealt each by itself, like any other rows. The law is `rows`: shard counts differ by one at most; grown_shard is null.
    """
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text")).alias("text_crc32"),
    )
    return shard_rows(digest, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
