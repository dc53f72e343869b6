"""Sources by name, and the catalogue's fixed schemas from files and from a database."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricelode.sources import readers, registry


@pytest.fixture()
def paths(tmp_path):
    feed = {"products": [{"asin": "A1", "title": "Feed", "manufacturer": "M", "lastUpdate": 5, "stats": {"current": [1000, 2000, -1, 7]}}, {"asin": "A2", "title": "No price", "stats": {"current": [-1, -1]}}]}
    paapi = {"ASIN": "A1", "DetailPageURL": "u", "ItemInfo": {"Title": {"DisplayValue": "API"}, "ByLineInfo": {"Brand": {"DisplayValue": "B"}}}, "Images": {"Primary": {"Large": {"URL": "i"}}}, "CustomerReviews": {"StarRating": {"Value": 4.5}, "Count": 3}, "Offers": {"Listings": [{"Price": {"Amount": 9.5, "Currency": "EUR"}, "Condition": {"Value": "New"}, "Availability": {"Type": "Now"}}]}}
    ebay = {"item": [{"itemId": ["7"], "title": ["Bay"], "galleryURL": ["g"], "viewItemURL": ["v"], "sellingStatus": [{"currentPrice": [{"__value__": "8.25"}]}], "condition": [{"conditionId": ["3000"]}], "shippingInfo": [{"shippingServiceCost": [{"__value__": "2.5"}]}]}]}
    static = [{"asin": "A3", "title": "Still", "brand": "S", "image": "x", "category": "ssds", "prices": {"de": 5, "us": 6}}]
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    (tmp_path / "paapi.json").write_text(json.dumps(paapi))
    (tmp_path / "ebay.json").write_text(json.dumps(ebay))
    (tmp_path / "static").mkdir()
    (tmp_path / "static" / "products-de.json").write_text(json.dumps(static))
    return {"static": str(tmp_path / "static"), "ebay": str(tmp_path / "ebay.json"), "amazon-paapi": str(tmp_path / "paapi.json"), "keepa": str(tmp_path / "feed.json")}


def test_all_sources_give_the_same_columns(spark, paths):
    got = {n: registry.products_of(spark, n, p) for n, p in paths.items()}
    assert list(registry.SOURCES) == ["keepa", "amazon-paapi", "ebay", "static"] and set(got) == set(registry.SOURCES)
    want = [(f.name, f.dataType) for f in StructType.fromDDL(registry.PRODUCT)]
    assert all([(f.name, f.dataType) for f in df.schema] == want for df in got.values())
    rows = {n: {r["id"]: r for r in df.collect()} for n, df in got.items()}
    assert (rows["keepa"]["A1"]["price"], rows["keepa"]["A1"]["brand"], rows["keepa"]["A2"]["price"]) == (10.0, "M", None)
    assert (rows["ebay"]["ebay-7"]["price"], rows["ebay"]["ebay-7"]["shipping_cost"]) == (8.25, 2.5) and rows["static"]["A3"]["price"] == 5.0
    merged = {r["id"]: r for r in registry.merged_products(spark, paths).collect()}
    assert set(merged) == {"A1", "A2", "A3", "ebay-7"} and (merged["A1"]["best_price"], merged["A1"]["best_source"]) == (9.5, "amazon-paapi")
    assert [s for s in merged["A1"]["sources"]] == ["keepa", "amazon-paapi"]
    first = {r["id"]: r["source"] for r in registry.first_products(spark, paths).collect()}
    assert first["A1"] == "keepa" and first["A3"] == "static"


def test_unknown_names_and_wrong_schemas_fail_early(spark, paths, tmp_path):
    with pytest.raises(ValueError, match="no source is called 'idealo'"):
        registry.merged_products(spark, {"idealo": "x", **paths})
    (tmp_path / "static" / "products-fr.json").write_text(json.dumps([{"asin": "A3", "prices": "5"}]))
    with pytest.raises(ValueError, match="static: title is missing; prices is string"):
        registry.products_of(spark, "static", paths["static"], "fr")
    rows = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match="rows: a is int, not bigint; c is missing"):
        registry.checked(rows, "a long, b string, c double", "rows")


def catalogue(spark):
    """One row a table, times in milliseconds or seconds."""
    out = {}
    for n, (t, ddl) in enumerate(readers.SCHEMAS.items()):
        fields = StructType.fromDDL(ddl)
        value = {"long": 1, "int": 2, "double": 1.5, "boolean": True, "string": "s"}
        row = spark.range(1).select(*[F.lit(1_700_000_000 * (1000 if n % 2 else 1)).alias(f.name) if f.name in readers._TIMES else F.lit(value.get(f.dataType.typeName(), 3)).cast(f.dataType).alias(f.name) for f in fields])
        out[t] = row
    return out


def test_catalogue_from_files(spark, tmp_path):
    for t, df in catalogue(spark).items():
        df.drop("gtin", "delivery_free").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = readers.read_catalog(spark, str(tmp_path), whole=True)
    for t, df in got.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in StructType.fromDDL(readers.SCHEMAS[t])]
        times = [c for c in df.columns if c in readers._TIMES]
        assert all(str(df.first()[c])[:10] == "2023-11-14" for c in times)
    assert got["products"].first()["gtin"] is None
    with pytest.raises(ValueError, match="missing \\['asin'\\], unknown \\['extra'\\]"):
        readers.as_table(catalogue(spark)["products"].drop("asin").withColumn("extra", F.lit(1)), "products")


def test_catalogue_from_a_database(spark):
    url = "jdbc:derby:memory:catalogue;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    for t, df in catalogue(spark).items():
        many = spark.range(50).crossJoin(df.drop("id")).select(*[F.col(c) for c in df.columns])
        many.write.format("jdbc").options(url=url, dbtable=t, **driver).mode("overwrite").save()
    got = readers.read_catalog_jdbc(spark, url, parts=4, step=10, **driver)
    for t, df in got.items():
        assert df.columns == StructType.fromDDL(readers.SCHEMAS[t]).names and df.rdd.getNumPartitions() == 4
        assert sorted(r["id"] for r in df.select("id").collect()) == list(range(50))
    assert str(got["prices"].first()["last_updated"])[:10] == "2023-11-14"
