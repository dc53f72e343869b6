"""Feed jobs run to the end: the catalogue and the prices after a sync, an import and an update,
with new, known, priceless and half-empty rows, and SQL for all the columns that they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import testdata
from ..sources.readers import FEED_SCHEMA
from . import ingest
from .registry import query

AS_OF, OLD = "2001-08-01", "2000-01-01"


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _plain(df: DataFrame) -> DataFrame:
    """Times without zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def _some(condition: str, value) -> Column:
    return F.when(F.expr(condition), value if isinstance(value, Column) else F.lit(value))


_CATALOGUE = """select id, asin, lower(asin) as slug, title, brand, 'M' as manufacturer, 'G' || id as gtin, 'old' as mpn, category, 'old.jpg' as image_url, cast(rating as double) as rating, review_count, sales_rank,
  cast(9 as bigint) as sales_rank_reference, monthly_sold, 'old text' as description, '["old"]' as features, '{}' as specifications, 'old' as variation_attributes, 'Used' as condition, parent_asin,
  capacity, capacity_unit, case when id % 9 <> 0 then capacity end as normalized_capacity, true as history_seeded, cast('2000-01-01' as timestamp) as created_at, cast('2000-01-01' as timestamp) as updated_at
from products"""

_KNOWN_PRICES = """select product_id, country, amazon_price, new_price, used_price, cast(1 as double) as warehouse_price, cast(2 as double) as list_price, cast(3 as double) as price_min, cast(4 as double) as price_max,
  price_avg_30, price_avg_90, cast(5 as double) as price_per_unit, 'XXX' as currency, 'old' as source, last_updated from prices"""


def _catalogue(spark: SparkSession, sf: str, where: str = "true") -> tuple[DataFrame, DataFrame]:
    """Products and prices with all columns of the catalogue; of the products that meet a condition."""
    p = spark.sql(_CATALOGUE.replace("{}", "{{}}").replace("from products", "from {products}"), products=testdata.products(spark, sf)).where(where)
    prices = spark.sql(_KNOWN_PRICES.replace("from prices", "from {prices}"), prices=testdata.prices(spark, sf))
    zoned = lambda df: df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind.startswith("timestamp")})
    return zoned(p), zoned(prices.join(p.select(F.col("id").alias("product_id")), "product_id", "left_semi"))


def _by_asin(prices: DataFrame, products: DataFrame) -> DataFrame:
    """Prices with the ASIN in place of an id, for new ids are any above the old ones."""
    return _plain(prices.join(products.select(F.col("id").alias("product_id"), "asin"), "product_id").drop("product_id"))


def _cents() -> Column:
    return F.floor(F.col("list_price") * 100).cast("long")


# ---- a sync: products of even id, of a catalogue without those divisible by four


def _synced(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    products, prices = _catalogue(spark, sf, "id % 4 <> 0")
    kind = FEED_SCHEMA.split("products array<", 1)[1].rsplit(">", 1)[0]
    none = F.lit(-1).cast("long")
    at = lambda condition, value: F.coalesce(_some(condition, value), none)
    figures = {0: at("id % 5 = 1", _cents()), 1: at("id % 5 = 2", _cents() + 100), 2: at("id % 5 = 3", _cents()), 3: at("id % 7 <> 0", F.lit(7).cast("long")), 4: _cents(), 16: at("id % 3 = 1", F.lit(45).cast("long")), 17: F.col("id") % 50}
    stats = F.struct(
        F.array(*[figures.get(i, none) for i in range(18)]).alias("current"), F.array(_cents(), none).alias("avg30"), F.array(none, at("id % 5 <> 0", _cents())).alias("avg90"),
        F.array(F.concat(F.lit("[77, "), _cents().cast("string"), F.lit("]"))).alias("min"), F.array(_cents().cast("string")).alias("max"),
    )
    text = F.col("id").cast("string")
    body = F.struct(
        "asin", _some("id % 14 <> 0", F.concat(F.lit("feed "), F.col("asin"))).alias("title"), _some("id % 3 <> 0", "Brand").alias("brand"), F.lit("Maker").alias("manufacturer"),
        _some("id % 3 = 1", F.concat(F.lit("i"), text, F.lit(".jpg,x.jpg"))).alias("imagesCSV"), _some("id % 3 = 1", F.array(F.lit("f1"), F.lit("f2"))).alias("features"), _some("id % 3 = 1", "feed text").alias("description"),
        _some("id % 5 <> 0", F.array(F.concat(F.lit("E"), text))).alias("eanList"), F.array(F.concat(F.lit("U"), text)).alias("upcList"), _some("id % 10 = 2", F.concat(F.lit("mpn"), text)).alias("mpn"),
        _some("id % 6 <> 0", F.col("id") % 100).alias("monthlySold"), F.lit(5).alias("lastUpdate"), stats.alias("stats"),
    )
    rows = testdata.products(spark, sf).where("id % 2 = 0").select(F.from_json(F.to_json(body), kind).alias("p")).select("p.*")
    earlier = rows.where("asin like '%2'").withColumns({"lastUpdate": F.lit(4).cast("long"), "title": F.lit("of an earlier row")})
    return ingest.sync_feed(rows.unionByName(earlier), products, prices, "de", _time(AS_OF))


_SYNC = f""", cat as ({_CATALOGUE}), known as (select * from cat where id % 4 <> 0), kp as ({_KNOWN_PRICES}),
feed as (select *, floor(list_price * 100) / 100e0 as cents, case when id % 5 = 1 then floor(list_price * 100) / 100e0 end as own, case when id % 5 = 2 then (floor(list_price * 100) + 100) / 100e0 end as fresh_price,
  case when id % 5 = 3 then floor(list_price * 100) / 100e0 end as second_hand, case when id % 3 = 1 then true else false end as rich, case when id % 3 = 0 then 'Maker' else 'Brand' end as maker from products where id % 2 = 0),
paid as (select *, coalesce(own, fresh_price, case when id % 5 <> 0 then cents end) as price from feed) """


@query(
    _SYNC
    + """select coalesce(k.asin, f.asin) as asin, k.id as known_id,
  coalesce(k.slug, lower(f.maker) || case when f.id % 14 <> 0 then '-feed-' else '-' end || lower(f.asin) || '-' || right(f.asin, 4)) as slug,
  case when f.id is null then k.title when f.id % 14 <> 0 then 'feed ' || f.asin else f.asin end as title, case when f.id is null then k.brand else f.maker end as brand,
  case when f.id is null then k.gtin when f.id % 5 <> 0 then 'E' || f.id else 'U' || f.id end as gtin, case when f.id is null then k.mpn when f.id % 10 = 2 then 'mpn' || f.id end as mpn,
  coalesce(k.category, 'hard-drives') as category, coalesce(case when f.rich then 'https://images-na.ssl-images-amazon.com/images/I/i' || f.id || '.jpg' end, k.image_url) as image_url,
  case when f.id is null then k.rating when f.rich then 4.5 end as rating, case when f.id is null then k.review_count else nullif(f.id % 50, 0) end as review_count,
  case when f.id is null then k.sales_rank when f.id % 7 <> 0 then 7 end as sales_rank, case when f.id is null then k.monthly_sold when f.id % 6 <> 0 then f.id % 100 end as monthly_sold,
  coalesce(case when f.rich then '["f1","f2"]' end, k.features) as features, coalesce(case when f.rich then 'feed text' end, k.description) as description, coalesce(k.condition, 'New') as condition,
  k.parent_asin, k.capacity, k.manufacturer, coalesce(k.history_seeded, false) as history_seeded, coalesce(k.created_at, cast('2001-08-01' as timestamp)) as created_at,
  case when f.id is null then k.updated_at else cast('2001-08-01' as timestamp) end as updated_at
from known k full join feed f on k.asin = f.asin"""
)
def synced_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """All that a sync keeps of products; new ids are told apart from known ones."""
    after, known = _synced(spark, sf)[0], _catalogue(spark, sf, "id % 4 <> 0")[0].select("asin", F.col("id").alias("old_id"))
    top = known.select(F.max("old_id")).scalar()
    rows = after.join(known, "asin", "left").where("old_id is null or old_id = id").where(F.col("old_id").isNotNull() | (F.col("id") > top)).withColumn("known_id", F.col("old_id"))
    return _plain(rows.drop("id", "old_id", "sales_rank_reference", "specifications", "variation_attributes", "capacity_unit", "normalized_capacity"))


@query(
    _SYNC
    + """select coalesce(k.asin, f.asin) as asin, coalesce(country, 'de') as country, case when f.id is null then amazon_price else f.own end as amazon_price, case when f.id is null then new_price else f.fresh_price end as new_price,
  case when f.id is null then used_price else f.second_hand end as used_price, k.warehouse_price, case when f.id is null then k.list_price else f.cents end as list_price, case when f.id is null then k.price_min else f.cents end as price_min,
  case when f.id is null then k.price_max else f.cents end as price_max, case when f.id is null then k.price_avg_30 else f.cents end as price_avg_30, k.price_avg_90, k.price_per_unit, coalesce(k.currency, 'EUR') as currency, coalesce(k.source, 'keepa') as source,
  case when f.id is null then k.last_updated else cast('2001-08-01' as timestamp) end as last_updated
from (select kp.*, known.asin from kp join known on product_id = known.id) k full join (select * from paid where price is not null) f on k.asin = f.asin and k.country = 'de'"""
)
def synced_prices(spark: SparkSession, sf: str) -> DataFrame:
    after, prices, _ = _synced(spark, sf)
    return _by_asin(prices, after)


@query(_SYNC + "select asin, 'de' as country, price, 'EUR' as currency, case when own is not null then 'amazon' else 'new' end as price_type, cast('2001-08-01' as timestamp) as recorded_at from paid where price is not null")
def synced_points(spark: SparkSession, sf: str) -> DataFrame:
    after, _, added = _synced(spark, sf)
    return _by_asin(added, after)


# ---- an import: a wide feed of products of odd id, of a catalogue without those divisible by three


def _imported(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    products, prices = _catalogue(spark, sf, "id % 3 <> 0")
    text = F.col("id").cast("string")
    money = lambda c: F.concat((c / 100).cast("long").cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"), F.lit(" €"))
    cells = {
        "ASIN": F.concat(F.lit(" "), F.lower("asin")), "Title": _some("id % 7 <> 0", F.concat(F.lit("Drive X"), text)), "Brand": _some("id % 4 = 1", "ACME"), "Manufacturer": _some("id % 4 = 3", "Maker"),
        "Categories: Root": F.lit("Elektronik"), "Categories: Sub": F.coalesce(_some("id % 11 = 0", "Socken"), F.lit("Festplatten")), "Description & Features: Description": _some("id % 5 = 1", "wide text"),
        "Description & Features: Feature 1": _some("id % 5 = 1", "one"), "Description & Features: Feature 2": F.lit(""), "Description & Features: Feature 3": F.lit("three"), "Image": _some("id % 5 = 1", "a.jpg;b.jpg"),
        "Reviews: Rating": F.lit("4.5 of 5"), "Reviews: Rating Count": text, "Sales Rank: Current": _some("id % 5 <> 2", text), "Sales Rank: Reference": F.lit("12"), "Bought in past month": _some("id % 3 = 1", "1.000+"),
        "Product Codes: EAN": _some("id % 5 = 1", F.concat(F.lit("E"), text)), "Product Codes: UPC": F.concat(F.lit("U"), text), "Product Codes: PartNumber": F.lit("P-1"), "Parent ASIN": _some("id % 5 = 1", "PARENT"),
        "Variation Attributes": F.lit("Size: 4"), "Unit Details: Unit Value": F.lit("4"), "Unit Details: Unit Type": F.lit("TB"), "Amazon: Current": _some("id % 5 = 1", money(_cents())), "New: Current": _some("id % 5 = 2", money(_cents() + 100)),
        "Used: Current": _some("id % 5 in (2, 3)", money(_cents() - 100)), "Warehouse Deals: Current": F.lit("-"), "List Price: Current": money(_cents()), "Amazon: 30 days avg.": _some("id % 5 = 3", money(_cents())),
        "New: 30 days avg.": _some("id % 5 = 1", money(_cents() + 5)), "Amazon: 90 days avg.": F.lit(""), "Model": F.lit("X"), "Color": _some("id % 5 = 1", "red"), "_place": F.col("id"),
    }
    feed = testdata.products(spark, sf).where("id % 2 = 1").select(*[v.alias(k) for k, v in cells.items()])
    earlier = feed.withColumns({"_place": F.lit(-1).cast("long"), "Title": F.lit("of an earlier row")}).where("`ASIN` like '%1' and `Categories: Sub` <> 'Socken' and `Brand` is not null").where(F.col("Reviews: Rating Count").cast("long") % 7 != 0)
    return ingest.import_csv(feed.unionByName(earlier), products, prices, "de", _time(AS_OF))


_IMPORT = f""", cat as ({_CATALOGUE}), known as (select * from cat where id % 3 <> 0), kp as ({_KNOWN_PRICES}),
feed as (select *, floor(list_price * 100) as cents, case when id % 5 = 1 then floor(list_price * 100) / 100e0 end as own, case when id % 5 = 2 then (floor(list_price * 100) + 100) / 100e0 end as fresh_price,
  case when id % 5 in (2, 3) then (floor(list_price * 100) - 100) / 100e0 end as second_hand, case when id % 5 = 3 then floor(list_price * 100) / 100e0 when id % 5 = 1 then (floor(list_price * 100) + 5) / 100e0 end as mean
  from products where id % 2 = 1 and id % 7 <> 0 and id % 11 <> 0) """


@query(
    _IMPORT
    + """select coalesce(k.asin, f.asin) as asin, k.id as known_id, case when f.id is null then k.title else 'Drive X' || f.id end as title, case when f.id is null then k.brand when f.id % 4 = 1 then 'ACME' end as brand,
  case when f.id is null then k.manufacturer when f.id % 4 = 3 then 'Maker' end as manufacturer, case when f.id is null then k.slug else case when f.id % 4 = 1 then 'acme-' else '' end || 'drive-x' || f.id || '-4tb-' || right(f.asin, 4) end as slug,
  case when f.id is null then k.gtin when f.id % 5 = 1 then 'E' || f.id else 'U' || f.id end as gtin, case when f.id is null then k.mpn else 'P-1' end as mpn, case when f.id is null then k.category else 'hard-drives' end as category,
  case when f.id is null then k.image_url when f.id % 5 = 1 then 'a.jpg' end as image_url, case when f.id is null then k.rating else 4.5 end as rating, case when f.id is null then k.review_count else f.id end as review_count,
  case when f.id is null then k.sales_rank when f.id % 5 <> 2 then f.id end as sales_rank, case when f.id is null then k.sales_rank_reference else 12 end as sales_rank_reference,
  case when f.id is null then k.monthly_sold when f.id % 3 = 1 then 1000 else 0 end as monthly_sold, case when f.id is null then k.description when f.id % 5 = 1 then 'wide text' end as description,
  case when f.id is null then k.features when f.id % 5 = 1 then '["one","three"]' else '["three"]' end as features, case when f.id is null then k.specifications when f.id % 5 = 1 then '{"Model":"X","Color":"red"}' else '{"Model":"X"}' end as specifications,
  case when f.id is null then k.variation_attributes else 'Size: 4' end as variation_attributes, coalesce(k.condition, 'New') as condition, case when f.id is null then k.parent_asin when f.id % 5 = 1 then 'PARENT' end as parent_asin,
  case when f.id is null then k.capacity else 4 end as capacity, case when f.id is null then k.capacity_unit else 'TB' end as capacity_unit, k.normalized_capacity, case when f.id is null then k.history_seeded else f.mean is not null end as history_seeded,
  coalesce(k.created_at, cast('2001-08-01' as timestamp)) as created_at, case when f.id is null then k.updated_at else cast('2001-08-01' as timestamp) end as updated_at
from known k full join feed f on k.asin = f.asin"""
)
def imported_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    after, known = _imported(spark, sf)[0], _catalogue(spark, sf, "id % 3 <> 0")[0].select("asin", F.col("id").alias("old_id"))
    rows = after.join(known, "asin", "left").where("old_id is null or old_id = id").withColumn("known_id", F.col("old_id"))
    return _plain(rows.drop("id", "old_id"))


@query(
    _IMPORT
    + """select coalesce(k.asin, f.asin) as asin, coalesce(country, 'de') as country, case when f.id is null then amazon_price else f.own end as amazon_price, case when f.id is null then new_price else f.fresh_price end as new_price,
  case when f.id is null then used_price else f.second_hand end as used_price, case when f.id is null then k.warehouse_price end as warehouse_price, case when f.id is null then k.list_price else f.cents / 100e0 end as list_price, k.price_min, k.price_max,
  case when f.id is null then k.price_avg_30 else f.mean end as price_avg_30, case when f.id is null then k.price_avg_90 end as price_avg_90, k.price_per_unit, coalesce(k.currency, 'EUR') as currency, coalesce(k.source, 'keepa') as source,
  case when f.id is null then k.last_updated else cast('2001-08-01' as timestamp) end as last_updated
from (select kp.*, known.asin from kp join known on product_id = known.id) k full join (select * from feed where own > 0 or fresh_price > 0) f on k.asin = f.asin and k.country = 'de'"""
)
def imported_prices(spark: SparkSession, sf: str) -> DataFrame:
    after, prices = _imported(spark, sf)
    return _by_asin(prices, after)


# ---- an update of stale prices: a feed of products of even id


def _updated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    products, prices = _catalogue(spark, sf)
    long = lambda c: c.cast("long")
    ranks = F.create_map(F.lit("1"), F.array(F.array(F.lit(1).cast("long"), F.lit(3).cast("long")), F.array(F.lit(2).cast("long"), F.col("id"))))
    feed = testdata.products(spark, sf).where("id % 2 = 0").select(
        "asin", _some("id % 5 in (0, 1)", F.col("list_price")).alias("amazon_price"), _some("id % 5 = 2", F.col("list_price") + 1).alias("new_price"), _some("id % 5 = 3", 5.0).alias("used_price"), F.lit(4.0).alias("warehouse_price"),
        _some("id % 3 = 0", ranks).alias("salesRanks"), long(F.col("id") % 50).alias("rating"), _some("id % 7 <> 0", F.col("id") % 7).alias("reviews"),
    )
    return ingest.update_prices(products, prices, feed, "de", _time(AS_OF))


_UPDATE = f""", cat as ({_CATALOGUE}), kp as ({_KNOWN_PRICES}),
due as (select p.*, case when id % 5 in (0, 1) then list_price end as own, case when id % 5 = 2 then list_price + 1 end as fresh_price, case when id % 5 = 3 then 5e0 end as second_hand
  from products p left join prices on product_id = id and country = 'de' where id % 2 = 0 and (last_updated is null or last_updated < cast('2001-07-31 13:00:00' as timestamp))),
paid as (select d.*, nullif(coalesce(own, fresh_price), 0) as price, normalized_capacity from due d join cat on cat.id = d.id where nullif(coalesce(own, fresh_price), 0) is not null) """


@query(
    _UPDATE
    + """select c.* exclude (sales_rank, rating, review_count, updated_at, history_seeded), case when d.id % 3 = 0 then d.id else c.sales_rank end as sales_rank, case when d.id % 50 > 0 then d.id % 50 / 10e0 else c.rating end as rating,
  case when d.id % 7 <> 0 then d.id % 7 else c.review_count end as review_count, case when d.id is null then c.updated_at else cast('2001-08-01' as timestamp) end as updated_at, history_seeded
from cat c left join due d on c.id = d.id"""
)
def updated_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_updated(spark, sf)[0])


@query(
    _UPDATE
    + """select coalesce(k.product_id, f.id) as product_id, coalesce(k.country, 'de') as country, case when f.id is null then amazon_price else f.own end as amazon_price, case when f.id is null then new_price else f.fresh_price end as new_price,
  case when f.id is null then used_price else f.second_hand end as used_price, case when f.id is null then k.warehouse_price else 4 end as warehouse_price, k.list_price, k.price_min, k.price_max, k.price_avg_30, k.price_avg_90,
  case when f.id is null then k.price_per_unit when f.normalized_capacity > 0 then round(f.price / f.normalized_capacity, 9) end as price_per_unit, coalesce(k.currency, 'EUR') as currency, coalesce(k.source, 'keepa') as source,
  case when f.id is null then k.last_updated else cast('2001-08-01' as timestamp) end as last_updated
from kp k full join paid f on k.product_id = f.id and k.country = 'de'"""
)
def updated_prices(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_updated(spark, sf)[1].withColumn("price_per_unit", F.round("price_per_unit", 9)))


@query(
    _UPDATE
    + """select f.id as product_id, 'de' as country, f.price, 'EUR' as currency, case when f.own is not null then 'amazon' else 'new' end as price_type, cast('2001-08-01' as timestamp) as recorded_at
from paid f join kp k on k.product_id = f.id and k.country = 'de' where coalesce(k.amazon_price, k.new_price) is distinct from f.price"""
)
def updated_points(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_updated(spark, sf)[2])
