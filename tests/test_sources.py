"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from pricelode.sources import readers, writers


def test_catalog_times(spark, tmp_path):
    spark.createDataFrame([(1, 1_700_000_000), (2, 1_700_000_000_000)], "id long, created_at long").write.parquet(str(tmp_path / "products.parquet"))
    got = readers.read_catalog(spark, str(tmp_path), ("products",))["products"]
    assert [r["t"] for r in got.select(F.unix_seconds("created_at").alias("t")).collect()] == [1_700_000_000] * 2


def test_feed_json(spark, tmp_path):
    body = {"products": [{"asin": "A", "title": "t", "stats": {"current": [100, -1], "min": ["[5, 90]"]}, "salesRanks": {"1": [[1, 2], [3, 4]]}}, {"asin": "B"}]}
    (tmp_path / "f.json").write_text(json.dumps(body))
    rows = {r["asin"]: r for r in readers.read_feed_json(spark, str(tmp_path / "f.json")).collect()}
    assert rows["A"]["stats"]["current"] == [100, -1] and rows["A"]["salesRanks"] == {"1": [[1, 2], [3, 4]]} and rows["B"]["stats"] is None


def test_market_json(spark, tmp_path):
    item = {"itemId": ["1"], "title": ["x"], "galleryURL": ["g"], "viewItemURL": ["u"], "sellingStatus": [{"currentPrice": [{"__value__": "9.5"}]}], "condition": [{"conditionId": ["1000"]}]}
    (tmp_path / "e.json").write_text(json.dumps({"item": [item]}))
    r = readers.read_ebay_json(spark, str(tmp_path / "e.json")).first()
    assert (r["item_id"], r["price"], r["condition_id"], r["shipping_cost"]) == ("1", 9.5, "1000", None)


def test_paapi_json(spark, tmp_path):
    item = {"ASIN": "A", "ItemInfo": {"Title": {"DisplayValue": "t"}}, "Offers": {"Listings": [{"Price": {"Amount": 3.5}, "Condition": {"Value": "New"}, "Availability": {"Type": "Now"}}]}, "CustomerReviews": {"StarRating": {"Value": 4.5}, "Count": 7}}
    (tmp_path / "p.json").write_text(json.dumps(item))
    r = readers.read_paapi_json(spark, str(tmp_path / "p.json")).first()
    assert (r["asin"], r["title"], r["price"], r["condition"], r["availability"], r["rating"], r["review_count"], r["brand"]) == ("A", "t", 3.5, "New", "Now", 4.5, 7, None)


def test_static_json(spark, tmp_path):
    (tmp_path / "products-de.json").write_text(json.dumps([{"asin": "A", "title": "de", "category": "ssds"}]))
    (tmp_path / "products-us.json").write_text(json.dumps([{"asin": "A", "title": "us", "category": "ssds"}, {"asin": "B", "title": "us", "category": "ram"}]))
    got = {r["asin"]: r["title"] for r in readers.read_static_json(spark, str(tmp_path), "de").collect()}
    assert got == {"A": "de", "B": "us"} and readers.read_static_json(spark, str(tmp_path), "de", "ram").count() == 1


def test_articles(spark, tmp_path):
    (tmp_path / "a.mdx").write_text('---\ntitle: "First: one"\npublishDate: 2024-01-01\nlastUpdated: "2024-02-01"\nauthorName: Ann\ntags: ["x", "y z"]\nreferences:\n  - https://a\n  - "https://b"\nfaqs:\n  - question: "Why?"\n    answer: Because\n---\n\nBody\n')
    (tmp_path / "b.mdx").write_text("---\ntitle: Second\npublishDate: 2024-03-01\n---\nText")
    b, a = readers.read_articles(spark, str(tmp_path)).collect()
    assert (a["slug"], a["title"], a["author_name"], a["tags"], a["references"], str(a["last_updated"]), a["body"]) == ("a", "First: one", "Ann", ["x", "y z"], ["https://a", "https://b"], "2024-02-01", "Body\n")
    assert [tuple(x) for x in a["faqs"]] == [("Why?", "Because")] and (b["slug"], b["tags"], b["faqs"], b["body"]) == ("b", [], [], "Text")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-02-05")], "product_id long, d string").select("product_id", F.to_timestamp("d").alias("recorded_at"))
    path = str(tmp_path / "t")
    for _ in range(2):
        writers.replace_table(df, path)
    writers.replace_table(spark.read.parquet(path).where("product_id = 1"), path)
    assert spark.read.parquet(path).count() == 1 and not (tmp_path / "t__old").exists() and not (tmp_path / "t__new").exists()
