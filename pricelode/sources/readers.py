"""Readers: catalogue tables, feeds, articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.semantics import epoch, filled

TABLES = ("products", "prices", "price_history", "affiliate_links", "product_identifiers", "product_offers")
_TIMES = ("created_at", "updated_at", "last_updated", "recorded_at")

FEED_SCHEMA = """products array<struct<asin:string, title:string, brand:string, manufacturer:string, imagesCSV:string, features:array<string>,
 description:string, eanList:array<string>, upcList:array<string>, mpn:string, monthlySold:bigint, salesRanks:map<string,array<array<bigint>>>,
 lastUpdate:bigint, parentAsin:string, categoryTree:array<struct<catId:bigint,name:string>>, csv:array<array<bigint>>,
 stats:struct<current:array<bigint>, avg30:array<bigint>, avg90:array<bigint>, min:array<string>, max:array<string>>>>"""


# The catalogue's columns; `not null` where the catalogue says so. Times are whole seconds or milliseconds, or timestamps.
SCHEMAS = {
    "products": """id long not null, asin string not null, gtin string, mpn string, sku string, slug string not null, title string not null, brand string, category string not null, image_url string,
 manufacturer string, capacity double, capacity_unit string, normalized_capacity double, form_factor string, technology string, condition string, rating double, review_count int, sales_rank int,
 sales_rank_reference int, monthly_sold int, parent_asin string, variation_attributes string, specifications string, raw_data string, features string, description string, energy_label string,
 history_seeded boolean, created_at timestamp not null, updated_at timestamp not null""",
    "prices": """id long not null, product_id long not null, country string not null, amazon_price double, amazon_price_formatted string, new_price double, used_price double, warehouse_price double,
 list_price double, price_min double, price_max double, price_avg_30 double, price_avg_90 double, price_per_unit double, currency string not null, availability string, delivery_time string,
 delivery_cost double, delivery_free boolean, source string not null, last_updated timestamp not null""",
    "price_history": "id long not null, product_id long not null, country string not null, price double not null, currency string not null, price_type string not null, recorded_at timestamp not null",
    "affiliate_links": "id long not null, product_id long not null, country string not null, source string not null, url string not null, created_at timestamp not null",
    "product_identifiers": "id long not null, product_id long not null, source string not null, external_id string not null, country string, created_at timestamp not null",
    "product_offers": """id long not null, product_id long not null, source string not null, merchant_name string not null, merchant_logo string, price double not null, currency string not null,
 shipping_cost double, total_price double, affiliate_url string not null, deep_link string, availability string, delivery_time string, merchant_rating double, merchant_review_count int, last_updated timestamp not null""",
}


def as_table(rows: DataFrame, table: str) -> DataFrame:
    """Rows as the catalogue has them: its columns in their order and types. Columns that may be null
    and are not there are null; one that may not and is not there is an error, and so are columns that the catalogue doesn't know."""
    schema = StructType.fromDDL(SCHEMAS[table])
    names = {c.lower(): c for c in rows.columns}
    missing = [f.name for f in schema if not f.nullable and f.name not in names]
    unknown = [c for c in names if c not in schema.names]
    if missing or unknown:
        raise ValueError(f"{table}: missing {missing}, unknown {unknown}")
    kinds = dict(rows.dtypes)

    def value(f: StructField) -> Column:
        if f.name not in names:
            return F.lit(None).cast(f.dataType)
        c, kind = F.col(f"`{names[f.name]}`"), kinds[names[f.name]]
        if f.name in _TIMES and (kind in ("int", "bigint") or kind.startswith("decimal")):
            c = epoch(c.cast("long"))
        return c.cast(f.dataType)

    return rows.select(*[value(f).alias(f.name) for f in schema])


def read_catalog(spark: SparkSession, path: str, tables: tuple[str, ...] = TABLES, whole: bool = False) -> dict[str, DataFrame]:
    """The catalogue's tables; whole-number times become timestamps. whole: exactly as in SCHEMAS."""
    out = {}
    for t in tables:
        df = spark.read.parquet(f"{path}/{t}.parquet")
        out[t] = as_table(df, t) if whole else df.withColumns({c: epoch(F.col(c)) for c, kind in df.dtypes if c in _TIMES and kind in ("int", "bigint")})
    return out


def read_catalog_jdbc(spark: SparkSession, url: str, tables: tuple[str, ...] = TABLES, parts: int = 16, step: int = 1_000_000, **options: str) -> dict[str, DataFrame]:
    """The catalogue's tables from a database, as in SCHEMAS. Each is read in `parts` ranges of its id at once;
    the first ones are `step` ids wide, the last one has the rest. options: user, password, driver, fetchsize."""
    out = {}
    for t in tables:
        ranged = {"partitionColumn": "id", "lowerBound": "0", "upperBound": str(parts * step), "numPartitions": str(parts)}
        out[t] = as_table(spark.read.format("jdbc").options(url=url, dbtable=t, **ranged, **options).load(), t)
    return out


def read_feed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide feed, all text, with its row's place in the file for last-one-wins."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False)
    return df.withColumn("_place", F.monotonically_increasing_id())


def read_feed_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED_SCHEMA).json(path).select(F.explode("products").alias("p")).select("p.*")


def read_ebay_json(spark: SparkSession, path: str) -> DataFrame:
    """Market items; every scalar comes in a list of one."""
    schema = """item array<struct<itemId:array<string>, title:array<string>, galleryURL:array<string>, viewItemURL:array<string>,
 sellingStatus:array<struct<currentPrice:array<struct<__value__:string>>>>, condition:array<struct<conditionId:array<string>>>,
 shippingInfo:array<struct<shippingServiceCost:array<struct<__value__:string>>>>>>"""
    i = F.col("i")
    one = lambda c: F.get(c, F.lit(0))
    return (
        spark.read.schema(schema).json(path).select(F.explode("item").alias("i"))
        .select(
            one(i["itemId"]).alias("item_id"), one(i["title"]).alias("title"), one(i["galleryURL"]).alias("image_url"), one(i["viewItemURL"]).alias("url"),
            one(one(i["sellingStatus"])["currentPrice"])["__value__"].try_cast("double").alias("price"),
            one(one(i["condition"])["conditionId"]).alias("condition_id"),
            one(one(i["shippingInfo"])["shippingServiceCost"])["__value__"].try_cast("double").alias("shipping_cost"),
        )
    )


def read_paapi_json(spark: SparkSession, path: str) -> DataFrame:
    schema = """ASIN string, DetailPageURL string, ItemInfo struct<Title:struct<DisplayValue:string>, ByLineInfo:struct<Brand:struct<DisplayValue:string>>>,
 Images struct<Primary:struct<Large:struct<URL:string>>>, CustomerReviews struct<StarRating:struct<Value:double>, Count:bigint>,
 Offers struct<Listings:array<struct<Price:struct<Amount:double,Currency:string>, Condition:struct<Value:string>, Availability:struct<Type:string>>>>"""
    first = F.get("Offers.Listings", F.lit(0))
    return spark.read.schema(schema).json(path).select(
        F.col("ASIN").alias("asin"), F.col("DetailPageURL").alias("url"), F.col("ItemInfo.Title.DisplayValue").alias("title"),
        F.col("ItemInfo.ByLineInfo.Brand.DisplayValue").alias("brand"), F.col("Images.Primary.Large.URL").alias("image_url"),
        first["Price"]["Amount"].alias("price"), first["Condition"]["Value"].alias("condition"), first["Availability"]["Type"].alias("availability"),
        F.col("CustomerReviews.StarRating.Value").alias("rating"), F.col("CustomerReviews.Count").alias("review_count"),
    )


def read_static_json(spark: SparkSession, folder: str, country: str, category: str | None = None) -> DataFrame:
    """Products of products-<country>.json, and of products-us.json where that lacks them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for rank, code in enumerate(dict.fromkeys((country, "us"))):
        path = f"{folder}/products-{code}.json"
        if hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(path)):
            found.append(spark.read.json(path, multiLine=True).withColumn("_rank", F.lit(rank)))
    if not found:
        raise FileNotFoundError(f"{folder} has products of neither {country} nor us")
    df = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
    best = F.row_number().over(Window.partitionBy("asin").orderBy("_rank"))
    df = df.withColumn("_n", best).where("_n = 1").drop("_n", "_rank")
    return df.where(F.col("category") == category) if category else df


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: front matter keys, body, reading order newest first."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    head = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    key = lambda k: filled(F.regexp_extract(head, rf"""(?m)^{k}:\s*["']?(.*?)["']?\s*$""", 1))
    # lists stand in one line in brackets, or below the key with a dash each
    block = lambda k: F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(\[[^\]]*\]|(?:\r?\n[ \t]+[^\n]*)+)", 1)
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")
    flat = lambda k: F.split(F.regexp_replace(block(k), r"[\[\]]", ""), r",")
    dashed = lambda k: F.regexp_extract_all(block(k), F.lit(r"(?m)^[ \t]+-[ \t]+(.*?)[ \t\r]*$"), F.lit(1))
    items = lambda k: F.filter(F.transform(F.when(block(k).startswith("["), flat(k)).otherwise(dashed(k)), bare), lambda x: x != "")
    part = lambda k: F.transform(F.regexp_extract_all(block("faqs"), F.lit(rf"(?m)^[ \t-]+{k}:[ \t]*(.*?)[ \t\r]*$"), F.lit(1)), bare)
    faqs = F.arrays_zip(part("question").alias("question"), part("answer").alias("answer"))
    return text.select(
        F.coalesce(key("slug"), F.regexp_extract("path", r"([^/]+)\.mdx?$", 1)).alias("slug"), key("title").alias("title"), key("description").alias("description"),
        key("category").alias("category"), key("publishDate").try_cast("date").alias("publish_date"), key("lastUpdated").try_cast("date").alias("last_updated"),
        key("readingTime").alias("reading_time"), key("authorName").alias("author_name"), key("authorRole").alias("author_role"),
        items("tags").alias("tags"), items("references").alias("references"), faqs.alias("faqs"),
        F.regexp_replace("value", r"(?s)^---\r?\n.*?\r?\n---\s*", "").alias("body"),
    ).orderBy(F.desc_nulls_last("publish_date"), "slug")
