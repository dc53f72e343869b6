"""Operators against plain Python on small tables."""

import random

import pandas as pd
from pyspark.sql import functions as F

from pricelode.operators import curation, history, listing, merge
from pricelode.plans import ingest
from pricelode.sources.writers import upsert
from pricelode.streaming import ticks


def test_similar_products_with_ties(spark):
    random.seed(1)
    rows = [(i, random.choice("ab"), float(random.randint(1, 6))) for i in range(60)]
    got = {(r["id"], r["place"]): r["other_id"] for r in listing.similar_products(spark.createDataFrame(rows, "id long, category string, price double"), 3).collect()}
    for i, c, p in rows:
        near = sorted((abs(q - p), j) for j, d, q in rows if d == c and j != i)[:3]
        assert [got.get((i, k + 1)) for k in range(len(near))] == [j for _, j in near]


def test_upsert_keeps_what_the_update_lacks(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, price double")
    u = spark.createDataFrame([(2, None), (3, "c")], "id long, name string")
    got = {r["id"]: (r["name"], r["price"]) for r in upsert(t, u, ["id"], insert_defaults={"price": 9.0}).collect()}
    assert got == {1: ("a", 1.0), 2: (None, 2.0), 3: ("c", 9.0)}
    assert sorted(upsert(upsert(t, u, ["id"]), u, ["id"]).collect()) == sorted(upsert(t, u, ["id"]).collect())


def test_greedy_against_plain(spark):
    random.seed(2)
    rows = [("de", i, f"A{i}", random.choice([None, "P1", "P2", "P3"]), random.choice("xyz"), float(random.randint(1, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "country string, id long, asin string, parent_asin string, category string, score double")
    got = [r["id"] for r in curation.greedy(df, curation.Options(6, 2)).orderBy("place").collect()]
    seen, used, want = set(), {}, []
    for _, i, asin, parent, cat, _ in sorted(rows, key=lambda r: (-r[5], r[1])):
        if asin in seen or (parent and parent in seen) or used.get(cat, 0) == 2 or len(want) == 6:
            continue
        seen |= {parent or asin, asin}
        used[cat] = used.get(cat, 0) + 1
        want.append(i)
    assert got == want


def test_merge_folds_in_order(spark):
    schema = "id long, title string, price double, source string, last_updated date"
    day = lambda d: pd.Timestamp(d).date()
    a = spark.createDataFrame([(1, "old", 5.0, "a", day("2024-01-01"))], schema)
    b = spark.createDataFrame([(1, "", 4.0, "b", day("2024-02-01"))], schema)
    c = spark.createDataFrame([(1, "late", 4.0, "c", day("2024-01-15"))], schema)
    r = merge.merge_sources([a, b, c], ["title"]).first()
    assert (r["title"], r["best_price"], r["best_source"], r["sources"]) == ("old", 4.0, "b", ["a", "b", "c"])


def test_feed_history(spark):
    feed = spark.createDataFrame([("A", [[0, 1000, 60, -1, 120, 900]]), ("B", None)], "asin string, csv array<array<long>>")
    assert [(r["price_type"], r["price"]) for r in history.explode_history(feed, {0: "amazon"}).orderBy("recorded_at").collect()] == [("amazon", 10.0), ("amazon", 9.0)]


def test_csv_import(spark, tmp_path):
    (tmp_path / "f.csv").write_text('ASIN,Title,Brand,Categories: Sub,Amazon: Current,Description & Features: Feature 1\nB000000001,"Disk, 4TB",ACME,Festplatten,"1.299,00 €",x\nB000000001,Disk 2 8TB,ACME,Festplatten,9.00,\n,none,,,,\nB2,Sock,,Socken,1,\n')
    from pricelode.sources.readers import read_feed_csv

    rows = ingest.feed_csv_products(read_feed_csv(spark, str(tmp_path / "f.csv"))).collect()
    assert [(r["asin"], r["category"], r["amazon_price"], r["features"]) for r in rows] == [("B000000001", "hard-drives", 9.0, [])]


def test_stream_into_a_table_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, float(i * 7 % 5), f"2024-01-01 00:00:{i:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "tick_id long, product_id long, price double, t string").select("product_id", "price", F.to_timestamp("t").alias("ts"), "tick_id")
    for lo in (0, 10, 20):
        df.where(f"tick_id >= {lo} and tick_id < {lo + 10}").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ticks.tick_stream(spark, str(tmp_path / "in"), df.schema, files=1)
    q = stream.writeStream.foreachBatch(ticks.upsert_sink(str(tmp_path / "now"), 4)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = ticks.tick_table(str(tmp_path / "now"), 4).read(spark).select("product_id", "price").collect()
    assert sorted(got) == sorted(ticks.latest(df).select("product_id", "price").collect())


def test_curation_gates_and_sections(spark):
    rows = [
        (1, "A1", "P", "x", "x.jpg", 300.0, 0.0, 50), (2, "A2", "P", "y", "x.jpg", 250.0, 0.0, 40), (3, "P", None, "z", "x.jpg", 260.0, 0.0, 30),
        (4, "A4", None, "x", None, 900.0, 0.0, 90), (5, "A5", None, "y", "x.jpg", 10.0, 11.0, 0),
    ]
    df = spark.createDataFrame(rows, "id long, asin string, parent_asin string, category string, image_url string, price double, price_avg_90 double, monthly_sold int").withColumns(
        {"price_avg_30": F.lit(0.0), "title": F.lit("t"), "brand": F.lit("b"), "condition": F.lit("New"), "sales_rank": F.lit(30000), "rating": F.lit(1.0), "review_count": F.lit(0), "country": F.lit("de")}
    )
    # no image: out; cheap and of low score: only as a deal
    assert sorted(r["id"] for r in curation.gated(df, curation.Options()).collect()) == [1, 2, 3]
    assert [r["id"] for r in curation.gated(df, curation.Options(needs_discount=True)).collect()] == [5]
    # a product called like another one's parent isn't its sibling
    got = curation.greedy(curation.gated(df, curation.Options()), curation.Options(5, sort="revenue")).orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 3]


def test_snapshot_with_warehouse(spark):
    prices = spark.createDataFrame([(1, "de", 5.0, None, 4.0, 3.0)], "product_id long, country string, amazon_price double, new_price double, used_price double, warehouse_price double")
    none = spark.createDataFrame([], "product_id long, country string, price_type string, price double, recorded_at timestamp")
    got = history.snapshot_history(prices, none, F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted((r["price_type"], r["price"]) for r in got) == [("amazon", 5.0), ("used", 4.0), ("warehouse", 3.0)]


def test_csv_import_to_the_end(spark):
    cols = ["ASIN", "Title", "Brand", "Categories: Sub", "Amazon: Current", "New: Current", "Amazon: 30 days avg."]
    feed = spark.createDataFrame([("A1", "Disk 4TB", "X", "Festplatten", "99.00", "", "90.00"), ("N1", "Disk 8TB", "X", "Festplatten", "", "", ""), ("N2", "Disk 9TB", "X", "Festplatten", "", "12,50 €", "")], cols)
    products = spark.createDataFrame([(7, "A1", "old", "x", 1)], "id long, asin string, title string, brand string, sales_rank long")
    prices = spark.createDataFrame([(7, "de", 1.0, 2.0, None)], "product_id long, country string, amazon_price double, new_price double, price_avg_30 double")
    after, now = ingest.import_csv(feed, products, prices, "de", F.lit("2024-01-01").cast("timestamp"))
    ids = {r["asin"]: r["id"] for r in after.collect()}
    assert ids["A1"] == 7 and len(set(ids.values())) == 3 and min(ids["N1"], ids["N2"]) > 7
    assert {r["asin"]: r["title"] for r in after.collect()}["A1"] == "Disk 4TB"
    got = {r["product_id"]: (r["amazon_price"], r["new_price"], r["price_avg_30"]) for r in now.collect()}
    assert got == {7: (99.0, None, 90.0), ids["N2"]: (None, 12.5, None)}
