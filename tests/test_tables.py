"""Bucket tables, batch history, and the streams that keep state."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricelode.sources.tables import BatchHistory, BucketTable, Commits
from pricelode.streaming import ticks


def files(path):
    return {p for p in path.rglob("*.parquet")}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_writes_about_its_own_size(spark, tmp_path):
    table = BucketTable(str(tmp_path), ("k",), (), 32, most=3)
    base = spark.range(10_000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    assert table.append(base) == 1
    before = files(tmp_path)
    size = sum(p.stat().st_size for p in before)
    few = spark.createDataFrame([(5, 1), (6, 1)], "k long, v int")
    table.append(few)
    added = files(tmp_path) - before
    # nothing is rewritten: at most two buckets get a small file each
    assert before <= files(tmp_path) and 1 <= len(added) <= 2 and sum(p.stat().st_size for p in added) < size / 10
    want = {k: int(k in (5, 6)) for k in range(10_000)}
    assert dict(table.read(spark).collect()) == want
    # only the buckets asked for are read
    asked = table.read(spark, few.limit(1))
    assert asked.where("k = 5").count() == 1 and len(asked.inputFiles()) <= 2 and asked.count() < 1000
    # 1 % of the keys, several times: buckets are compacted, keys stay unique, old files go
    for n in range(2, 8):
        table.append(base.where(F.col("k") % 100 == n).withColumn("v", F.lit(n)))
        want |= {k: n for k in range(n, 10_000, 100)}
    got = table.read(spark).collect()
    assert len(got) == 10_000 and dict(got) == want
    _, state = Commits(spark, str(tmp_path)).latest()
    assert max(map(len, state["buckets"].values())) <= 3 and len(Commits(spark, str(tmp_path)).numbers()) == 2
    used = {f for own in state["buckets"].values() for f in own}
    assert len(Commits(spark, str(tmp_path)).folders("data")) <= len(used) + 4
    table.compact(spark, 1)
    assert rows_of(table.read(spark)) == sorted(want.items()) and "Exchange" not in table.read(spark)._jdf.queryExecution().toString()


def test_order_ties_nulls_and_new_columns(spark, tmp_path):
    table = BucketTable(str(tmp_path), ("a", "b"), ("t",), 4)
    df = lambda rows, more="": spark.createDataFrame(rows, "a string, b int, t int, v string" + more)
    table.append(df([("x", 1, 5, "five"), ("x", 1, 3, "three"), ("x", None, 9, "no key"), ("y", 2, None, "no time")]))
    table.append(df([("x", 1, 4, "older"), ("y", 2, 0, "timed"), ("z", 3, 1, "z")]))
    table.append(df([("x", 1, 5, "same time, later")]))
    table.append(df([("z", 3, 2, "z", 1.5)], ", w double"))
    table.append(df([]))
    assert sorted(table.read(spark).collect(), key=str) == [("x", 1, 5, "same time, later", None), ("y", 2, 0, "timed", None), ("z", 3, 2, "z", 1.5)]
    with pytest.raises(ValueError, match="was written with"):
        BucketTable(str(tmp_path), ("a", "b"), ("t",), 8).append(df([]))
    with pytest.raises(FileNotFoundError):
        BucketTable(str(tmp_path / "none"), ("a",)).read(spark)


def test_upsert_keeps_what_the_update_lacks(spark, tmp_path):
    table = BucketTable(str(tmp_path), ("asin",), (), 8)
    table.append(spark.createDataFrame([(f"A{i}", f"t{i}", i, "Used") for i in range(200)], "asin string, title string, rank int, condition string"))
    updates = spark.createDataFrame([("A7", "new title", None), ("N1", "fresh", 3)], "asin string, title string, rank int")
    before = files(tmp_path)
    table.upsert(updates, ["title"], {"condition": "New"})
    assert len(files(tmp_path) - before) <= 2
    got = {r["asin"]: tuple(r)[1:] for r in table.read(spark).collect()}
    assert len(got) == 201 and got["A7"] == ("new title", 7, "Used") and got["N1"] == ("fresh", 3, "New") and got["A8"] == ("t8", 8, "Used")


def test_a_writer_that_is_late_or_dies(spark, tmp_path):
    table = BucketTable(str(tmp_path), ("k",), (), 4)
    table.append(spark.createDataFrame([(1, 1)], "k int, v int"))
    log = Commits(spark, str(tmp_path))
    number, state = log.latest()
    # files without a commit are not part of the table
    table._write(spark, spark.createDataFrame([(2, 2)], "k int, v int"), log, number + 1)
    assert table.read(spark).count() == 1
    log.commit(number + 1, state)
    with pytest.raises(RuntimeError, match="another writer"):
        log.commit(number + 1, state)
    assert log.latest()[0] == number + 1


def test_history_is_appended_once(spark, tmp_path):
    history = BatchHistory(str(tmp_path), most=4)
    batch = lambda n: spark.createDataFrame([(n, datetime(2024, 1 + n % 3, 5))], "product_id int, recorded_at timestamp")
    assert history.append(batch(0), "b0")
    assert not history.append(batch(0), "b0")  # a rerun
    for n in range(1, 19):
        assert history.append(batch(n), f"b{n}")
        assert not history.append(batch(n), f"b{n}")
        assert sorted(r[0] for r in history.read(spark).collect()) == list(range(n + 1))
    # batches are merged, level by level
    _, state = Commits(spark, str(tmp_path)).latest()
    assert len(state["folders"]) < 8
    late = history.read(spark, "2024-02")
    assert sorted(r[0] for r in late.collect()) == [n for n in range(19) if n % 3]
    assert all("_month=2024-01" not in f for f in late.where("1 = 1").inputFiles()) or "PartitionFilters: [isnotnull(_month" in late._jdf.queryExecution().toString()
    assert history.append(batch(1).limit(0), "empty") and history.read(spark).count() == 19


def tick_rows(n, seed=1, days=30):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(rng.randint(1, 4), float(rng.randint(1, 3)), start + timedelta(minutes=rng.randint(0, days * 1440)), i) for i in range(n)]


_TICK = "product_id long, price double, ts timestamp, tick_id long"


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in stream.sparkSession.table(name).collect())


def test_streams_in_any_order_equal_the_batch(spark, tmp_path):
    rows = sorted(tick_rows(300), key=lambda r: r[2])
    rng = random.Random(2)
    for lo in range(0, 300, 60):  # five batches, each in any order; batches overlap in time
        part = rows[lo : lo + 60]
        if lo:
            part[:3], rows[lo - 3 : lo] = rows[lo - 3 : lo], part[:3]
    batches = [rows[lo : lo + 60] for lo in range(0, 300, 60)]
    batches.append([(99, 1.0, datetime(2024, 8, 1), 1000)])  # moves the watermark beyond all of them
    for b in batches:
        rng.shuffle(b)
        spark.createDataFrame(b, _TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([r for b in batches for r in b], _TICK)
    stream = lambda: ticks.tick_stream(spark, str(tmp_path / "in"), table.schema, files=1)
    by = defaultdict(list)
    for r in sorted((r for b in batches for r in b), key=lambda r: (r[2], r[3])):
        by[r[0]].append(r)
    want = sorted((p, a[1], b[1], b[2]) for p, own in by.items() for a, b in zip(own, own[1:]) if a[1] != b[1])  # noqa: B905
    assert sorted(tuple(r) for r in ticks.price_changes(table).collect()) == want
    assert run(ticks.price_changes(stream(), delay="10 days"), tmp_path, "changes") == want
    first = []
    for p, own in by.items():
        last = None
        for r in own:
            if last is None or r[2] - last >= timedelta(hours=23):
                first.append((p, r[1], r[2]))
                last = r[2]
    assert sorted(tuple(r) for r in ticks.snapshots(table).collect()) == sorted(first)
    assert run(ticks.snapshots(stream(), delay="10 days"), tmp_path, "snaps") == [r for r in sorted(first) if r[0] != 99]
    # idle products are forgotten
    idle = sorted((p, a[1], b[1], b[2]) for p, own in by.items() for a, b in zip(own, own[1:]) if a[1] != b[1] and b[2] - a[2] < timedelta(days=1))  # noqa: B905
    assert idle != want and sorted(tuple(r) for r in ticks.price_changes(table, 1).collect()) == idle
    assert run(ticks.price_changes(stream(), 1, "10 days"), tmp_path, "idle") == idle
    # windows of a stream
    averages = run(ticks.sliding_average(stream(), 7, "10 days"), tmp_path, "averages")
    batch = {tuple(r)[:2]: tuple(r)[2:] for r in ticks.sliding_average(table, 7).collect()}
    assert len(averages) > 50 and all(batch[r[:2]] == pytest.approx(r[2:]) for r in averages if r[0] != 99)
    days = run(ticks.daily_range(stream(), "10 days"), tmp_path, "days")
    assert days == sorted(tuple(r) for r in ticks.daily_range(table).where("product_id <> 99").collect())


def test_state_of_idle_products_expires(spark, tmp_path):
    """The store holds no row of a product whose last tick is long behind the watermark."""
    batches = [[(p, float(p), datetime(2024, 1, 1, p % 20), p) for p in range(1, 40)]] + [[(100, 1.0, datetime(2024, 1, 1) + timedelta(days=3 * k), 100 + k)] for k in range(1, 5)]
    for b in batches:
        spark.createDataFrame(b, _TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ticks.price_changes(ticks.tick_stream(spark, str(tmp_path / "in"), _TICK, files=1), 2, "1 hour")
    q = stream.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress]
    assert max(held) >= 40 and held[-1] <= 6


def test_panes_shuffle_no_copies_of_ticks(spark):
    table = spark.createDataFrame(tick_rows(400), _TICK)
    plain = table.groupBy("product_id", F.window("ts", "30 days", "1 day").alias("w")).agg(F.avg("price").alias("a"), F.count("*").alias("n")).select("product_id", "w.end", "a", "n")
    got, want = ({(r[0], r[1]): (r[2], r[3]) for r in df.collect()} for df in (ticks.sliding_average(table, 30), plain))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = ticks.sliding_average(table, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") <= 1 and plan.rindex("Aggregate") > plan.find("Expand")  # copies are made above the first sum


def test_sink_in_buckets(spark, tmp_path):
    path = str(tmp_path / "now")
    tick = lambda rows: spark.createDataFrame(rows, "product_id long, price double, t string, tick_id long").select("product_id", "price", F.to_timestamp("t").alias("ts"), "tick_id")
    sink = ticks.upsert_sink(path, 8)
    sink(tick([(1, 5.0, "2024-01-02 00:00:00", 1), (2, 6.0, "2024-01-01 00:00:00", 2)]), 0)
    late = tick([(1, 9.0, "2024-01-01 00:00:00", 3), (2, 7.0, "2024-01-03 00:00:00", 4), (3, 1.0, "2024-01-01 00:00:00", 5)])
    for _ in range(2):  # a batch that is run again
        sink(late, 1)
    now = lambda: {r["product_id"]: r["price"] for r in ticks.tick_table(path, 8).read(spark).collect()}
    assert now() == {1: 5.0, 2: 7.0, 3: 1.0}
    ticks.upsert_sink(path, 8)(tick([(4, 2.0, "2024-01-01 00:00:00", 6)]), 0)  # a new query begins with batch 0
    assert now() == {1: 5.0, 2: 7.0, 3: 1.0, 4: 2.0}
    sink(late.limit(0), 2)
    assert len(now()) == 4
