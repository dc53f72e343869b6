"""Price ticks as streams; each job also takes a batch of ticks.

A tick is (product_id, price, ts, tick_id); ts is a timestamp with zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.tables import BucketTable


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("product_id"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"))


def tick_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 64) -> DataFrame:
    """The Parquet files of a folder as a stream of at most `files` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def dedupe_ticks(ticks: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Late ticks and ticks seen before are dropped."""
    if not ticks.isStreaming:
        return ticks.dropDuplicates(["tick_id"])
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tick_id"])


def latest(ticks: DataFrame) -> DataFrame:
    """The last tick of each product."""
    m = F.max(F.struct("ts", "tick_id", "price")).alias("m")
    return ticks.groupBy("product_id").agg(m).select("product_id", "m.price", F.col("m.ts").alias("last_updated"))


def daily_range(ticks: DataFrame, delay: str = "24 hours") -> DataFrame:
    t = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    return t.groupBy("product_id", F.window("ts", "1 day").alias("w")).agg(F.min("price").alias("low"), F.max("price").alias("high")).select("product_id", F.col("w.start").alias("day"), "low", "high")


def sliding_average(ticks: DataFrame, days: int = 30, delay: str = "24 hours") -> DataFrame:
    """Average of the last `days` days at the end of each day that has a tick in them. Ticks are
    summed by day first, and only those sums, not the ticks, are copied into each window."""
    t = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    panes = t.groupBy("product_id", F.window("ts", "1 day").alias("pane")).agg(F.sum("price").alias("total"), F.count("price").alias("priced"), F.count("*").alias("ticks"))
    w = F.window(F.window_time("pane"), f"{days} days", "1 day").alias("w")
    out = panes.groupBy("product_id", w).agg(F.try_divide(F.sum("total"), F.sum("priced")).alias("average"), F.sum("ticks").alias("ticks"))
    return out.select("product_id", F.col("w.end").alias("until"), "average", "ticks")


def tick_table(path: str, buckets: int = 64) -> BucketTable:
    """The last tick of each product, as upsert_sink() keeps it."""
    return BucketTable(path, ("product_id",), ("last_updated",), buckets)


def upsert_sink(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the last tick of each product goes into a table of hash buckets, and only
    what the batch brings is written. A late tick never replaces a newer one, so a batch that is
    run again changes nothing, and a query that begins anew on a table goes on with it."""
    table = tick_table(path, buckets)

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.append(latest(batch))

    return sink


def newest(table: DataFrame, new: DataFrame) -> DataFrame:
    """product_id, price, last_updated: of both, the row with the later time; a tie takes `new`."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    m = F.max(F.struct("last_updated", "_new", "price")).alias("m")
    return both.groupBy("product_id").agg(m).select("product_id", "m.price", "m.last_updated")


_CHANGE = "product_id long, old_price double, price double, ts timestamp"
_SNAPSHOT = "product_id long, price double, ts timestamp"
#: Pending ticks of a product are kept by the hour.
SLOT_MS = 3_600_000


class _InOrder(StatefulProcessor):
    """Hands on a product's ticks in the order of time, whatever order they come in.

    Ticks wait in the state, by the hour, until the watermark has passed the hour's end; a
    timer then takes that hour's ticks, and no more of them than that are in memory. What
    step() keeps of a product is dropped by another timer `idle_ms` after its last tick.
    """

    def __init__(self, idle_ms: int, columns: list[str]):
        self.idle_ms, self.columns = idle_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slot long", "ts array<long>, tick array<long>, price array<double>")
        self.kept = handle.getValueState("kept", "ts long, price double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            frame = frame.dropna(subset=["ts", "price"])
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            for slot, at in micros.groupby(micros // (SLOT_MS * 1000)).groups.items():
                had = self.pending.getValue((int(slot),)) if self.pending.containsKey((int(slot),)) else ([], [], [])
                new = (micros[at].tolist(), frame["tick_id"][at].astype("int64").tolist(), frame["price"][at].astype(float).tolist())
                self.pending.updateValue((int(slot),), tuple([*a, *b] for a, b in zip(had, new, strict=True)))
                self.handle.registerTimer((int(slot) + 1) * SLOT_MS)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        slot = (now // SLOT_MS - 1,)
        kept, out = (tuple(self.kept.get()) if self.kept.exists() else None), []
        if now % SLOT_MS == 0 and self.pending.containsKey(slot):
            for ts, _, price in sorted(zip(*self.pending.getValue(slot), strict=True)):
                kept, row = self.step(kept if kept and ts - kept[0] < self.idle_ms * 1000 else None, ts, price)
                if row is not None:
                    out.append((key[0], *row))
            self.pending.removeKey(slot)
            self.kept.update(kept)
            self.handle.registerTimer(kept[0] // 1000 + self.idle_ms + 1)
        elif kept and kept[0] // 1000 + self.idle_ms < now:
            self.kept.clear()
        if out:
            frame = pd.DataFrame(out, columns=self.columns)
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            yield frame

    def step(self, kept: tuple | None, ts: int, price: float) -> tuple[tuple, tuple | None]:
        """What is kept of a product after a tick, and the row that the tick makes."""
        raise NotImplementedError


class _Changes(_InOrder):
    def step(self, kept: tuple | None, ts: int, price: float) -> tuple[tuple, tuple | None]:
        return (ts, price), (kept[1], price, ts) if kept and kept[1] != price else None


class _Snapshots(_InOrder):
    def step(self, kept: tuple | None, ts: int, price: float) -> tuple[tuple, tuple | None]:
        return (kept, None) if kept else ((ts, price), (price, ts))


def _stateful(ticks: DataFrame, processor: _InOrder, schema: str, delay: str) -> DataFrame:
    # the state store must be one that has timers
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = ticks.withWatermark("ts", delay).select("product_id", "price", "ts", "tick_id")
    return rows.groupBy("product_id").transformWithStateInPandas(processor, schema, "append", "eventTime")


def price_changes(ticks: DataFrame, idle_days: int = 90, delay: str = "24 hours") -> DataFrame:
    """product_id, old_price, price, ts: a row when a product's price differs from that of the
    tick before it, by ts, then tick_id. After `idle_days` without a tick a product is
    forgotten, and its next tick counts as the first one. Ticks without a time or a price are left out.

    A stream reports a change when the watermark has passed the hour of the tick, so ticks
    that come in any order within `delay` give what the batch gives.
    """
    if ticks.isStreaming:
        return _stateful(ticks, _Changes(idle_days * 86_400_000, ["product_id", "old_price", "price", "ts"]), _CHANGE, delay)
    by = Window.partitionBy("product_id").orderBy("ts", "tick_id")
    rows = ticks.where("ts is not null and price is not null").withColumns({"old_price": F.lag("price").over(by), "_before": F.lag("ts").over(by)})
    fresh = F.unix_micros("ts") - F.unix_micros("_before") < idle_days * 86_400_000_000
    return rows.where((F.col("old_price") != F.col("price")) & fresh).select("product_id", "old_price", "price", "ts")


def snapshots(ticks: DataFrame, hours: int = 23, delay: str = "24 hours") -> DataFrame:
    """product_id, price, ts: one tick of a product in `hours`, the first, then the first that
    is so much later. Ticks without a time or a price are left out. A stream keeps a product's state no longer than `hours`
    behind the watermark; it gives what the batch gives for ticks in any order within `delay`."""
    if ticks.isStreaming:
        return _stateful(ticks, _Snapshots(hours * 3_600_000, ["product_id", "price", "ts"]), _SNAPSHOT, delay)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by product and time, so all that is held is the last row taken
        product, last = None, 0
        for batch in batches:
            keep = []
            for i, (p, ts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if product is None or p != product[0] or ts - last >= hours * 3_600_000_000:
                    product, last = (p,), ts
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1, 2])

    rows = ticks.where("ts is not null and price is not null").select(F.col("product_id").cast("long").alias("product_id"), "price", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "tick_id")
    return rows.repartition("product_id").sortWithinPartitions("product_id", "micros", "tick_id").drop("tick_id").mapInArrow(first, _SNAPSHOT)
