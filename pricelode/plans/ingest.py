"""Composed jobs: feeds into the catalogue, price updates, deployment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, normalize
from ..functions.semantics import filled, first_nonzero
from ..operators import catalog
from ..sources.writers import upsert

# Columns of the wide feed.
FEATURES = [f"Description & Features: Feature {i}" for i in range(1, 11)]
SPECS = [
    "Model", "Color", "Size", "Material", "Style", "Pattern", "Item: Dimension (cm³)", "Item: Weight (g)", "Package: Dimension (cm³)",
    "Package: Weight (g)", "Release Date", "Operating System", "Hardware Interface",
]


def last_by_place(df: DataFrame, key: str, place: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(place)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def feed_csv_products(feed: DataFrame) -> DataFrame:
    """Catalogue rows of a wide feed: rows without ASIN, title or category drop out, of several
    rows of one ASIN the last stays. Columns that the feed lacks count as empty. raw_data is the
    whole row as JSON; history_seeded says whether the feed has an average."""
    col = lambda c: F.col(f"`{c}`") if c in feed.columns else F.lit(None).cast("string")
    some = lambda names: [c for c in names if c in feed.columns]
    none = F.array().cast("array<string>")
    sold = filled(col("Bought in past month"))
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in feed.columns if c != "_place"]))
    rows = feed.where(filled(col("ASIN")).isNotNull() & filled(col("Title")).isNotNull()).select(
        F.upper(F.trim(col("ASIN"))).alias("asin"), col("Title").alias("title"), filled(col("Brand")).alias("brand"), filled(col("Manufacturer")).alias("manufacturer"),
        filled(col("Description & Features: Description")).alias("description"), raw.alias("raw_data"),
        normalize.map_category(col("Categories: Root"), col("Categories: Sub")).alias("category"),
        filled(F.split_part(col("Image"), F.lit(";"), F.lit(1))).alias("image_url"),
        normalize.parse_float_prefix(col("Reviews: Rating")).alias("rating"), normalize.parse_count(col("Reviews: Rating Count")).alias("review_count"),
        normalize.parse_count(col("Sales Rank: Current")).alias("sales_rank"), normalize.parse_count(col("Sales Rank: Reference")).alias("sales_rank_reference"),
        F.when(sold.isNull(), F.lit(0).cast("long")).otherwise(F.regexp_replace(sold, r"[^0-9]", "").try_cast("long")).alias("monthly_sold"),
        normalize.first_filled(col("Product Codes: EAN"), col("Product Codes: UPC"), col("Product Codes: GTIN")).alias("gtin"),
        filled(col("Product Codes: PartNumber")).alias("mpn"), filled(col("Parent ASIN")).alias("parent_asin"), filled(col("Variation Attributes")).alias("variation_attributes"), normalize.parse_float_prefix(col("Unit Details: Unit Value")).alias("capacity"),
        filled(col("Unit Details: Unit Type")).alias("capacity_unit"),
        (normalize.collect_filled(some(FEATURES)) if some(FEATURES) else none).alias("features"),
        (F.to_json(normalize.collect_specs(some(SPECS))) if some(SPECS) else F.lit("{}")).alias("specifications"),
        *[normalize.parse_price(col(c)).alias(n) for n, c in (
            ("amazon_price", "Amazon: Current"), ("new_price", "New: Current"), ("used_price", "Used: Current"), ("warehouse_price", "Warehouse Deals: Current"),
            ("list_price", "List Price: Current"),
        )],
        *[first_nonzero(normalize.parse_price(col(f"Amazon: {d} days avg.")), normalize.parse_price(col(f"New: {d} days avg."))).alias(f"price_avg_{d}") for d in (30, 90)],
        F.col("_place") if "_place" in feed.columns else F.monotonically_increasing_id().alias("_place"),
    )
    rows = last_by_place(rows.where("category is not null"), "asin", "_place").drop("_place")
    slug = normalize.product_slug(F.col("title"), F.col("brand"), F.col("asin"), F.col("capacity"), F.col("capacity_unit"))
    return rows.withColumn("slug", slug).withColumn("history_seeded", F.coalesce("price_avg_30", "price_avg_90").isNotNull())


IMAGES = "https://images-na.ssl-images-amazon.com/images/I/"


def feed_json_products(feed: DataFrame) -> DataFrame:
    """Catalogue rows of feed products with prices, rank, averages and category."""
    d = normalize.decode_stats(feed)
    image = filled(F.split_part("imagesCSV", F.lit(","), F.lit(1)))
    at = lambda c, i: normalize.cents_to_price(F.get(c, F.lit(i)))
    return d.select(
        "asin", normalize.first_filled(F.col("title"), F.col("asin")).alias("title"), normalize.first_filled(F.col("brand"), F.col("manufacturer")).alias("brand"),
        F.coalesce(F.get("eanList", F.lit(0)), F.get("upcList", F.lit(0))).alias("gtin"), filled(F.col("mpn")).alias("mpn"), F.lit("hard-drives").alias("category"),
        F.concat(F.lit(IMAGES), image).alias("image_url"), F.to_json("features").alias("features"), "description",
        "sales_rank", "rating", "review_count", F.col("monthlySold").alias("monthly_sold"),
        filled(F.col("parentAsin")).alias("parent_asin"), "amazon_price", "new_price", "used_price", "warehouse_price", "list_price",
        at("stats.avg30", 0).alias("price_avg_30"), at("stats.avg90", 0).alias("price_avg_90"),
        normalize.minmax_price(F.get("stats.min", F.lit(0))).alias("price_min"), normalize.minmax_price(F.get("stats.max", F.lit(0))).alias("price_max"),
        metrics.sync_price(F.col("amazon_price"), F.col("new_price"), at("stats.avg90", 1)).alias("price"),
    )


def with_ids(new: DataFrame, products: DataFrame, parts: int = 4096) -> DataFrame:
    """`new` (asin, ...) with id: the product's own, or one above all that there are. Fresh
    ids are numbered within parts of the ASINs, so no task sees all of them, and reruns agree."""
    top = F.coalesce(products.select(F.max("id")).scalar(), F.lit(0).cast("long"))
    known = new.join(products.select("asin", "id"), "asin", "left")
    part = F.pmod(F.xxhash64("asin"), F.lit(parts))
    n = F.row_number().over(Window.partitionBy(part).orderBy("asin"))
    fresh = known.where("id is null").withColumn("id", (top + 1 + (n - 1) * parts + part).cast("long"))
    return known.where("id is not null").unionByName(fresh)


#: What a new row gets where nothing is said: the catalogue's own defaults.
NEW_PRODUCT = {"condition": "New", "history_seeded": False}


def _upserted(products: DataFrame, new: DataFrame, as_of: Column, kept: tuple[str, ...], if_present: tuple[str, ...] = ()) -> DataFrame:
    """products after `new`, which brings ids. On known products the columns of `kept` stay, and those
    of `if_present` where `new` has none; a new product is created at as_of."""
    brought = [c for c in new.columns if c in products.columns]
    cols = [c for c in brought if c not in ("asin", "id", *kept)]
    if stay := [c for c in if_present if c in brought]:
        old = products.select("asin", *[F.col(c).alias(f"_old_{c}") for c in stay])
        new = new.join(old, "asin", "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_old_{c}").cast(new.schema[c].dataType)) for c in stay})
    new = new.select(*brought)
    if "created_at" in products.columns and "created_at" not in brought:
        new = new.withColumn("created_at", as_of)
    return upsert(products, new, ["asin"], cols, NEW_PRODUCT)


def _priced(prices: DataFrame, rows: DataFrame, columns: list[str], country: str, currency: str, source: str, as_of: Column) -> DataFrame:
    """prices after `rows` (product_id, ...), which overwrite `columns`, nulls too; what else a known price
    has stays, a new one gets currency and source."""
    cols = [c for c in columns if c in prices.columns and c in rows.columns]
    new = rows.select("product_id", F.lit(country).alias("country"), *cols, as_of.alias("last_updated"))
    return upsert(prices, new, ["product_id", "country"], insert_defaults={"currency": currency, "source": source})


def _history(rows: DataFrame, price: Column, country: str, currency: str, as_of: Column) -> DataFrame:
    return rows.select("product_id", F.lit(country).alias("country"), price.alias("price"), F.lit(currency).alias("currency"), metrics.buyable_type(F.col("amazon_price")).alias("price_type"), as_of.alias("recorded_at"))


#: Fixed value: the name of the feed in prices.
FEED = "keepa"
PRICES = ["amazon_price", "new_price", "used_price"]


def sync_feed(feed: DataFrame, products: DataFrame, prices: DataFrame, country: str, as_of: Column, currency: str = "EUR") -> tuple[DataFrame, DataFrame, DataFrame]:
    """products and prices after the feed, and the history rows that it adds.

    Of several rows of one ASIN the last updated counts. A new product gets an id, a slug, the
    condition New and as_of as the time it was created; on a known one slug, category and parent stay, and so do features,
    description and image where the feed has none. A product without any price (its
    own, new, or the average of new ones) gets neither a price nor a history row.
    """
    last = F.max_by(F.struct(*[F.col(c) for c in feed.columns]), F.coalesce(F.col("lastUpdate"), F.lit(0).cast("long")))
    new = feed_json_products(feed.groupBy("asin").agg(last.alias("r")).select("r.*"))
    none = F.lit(None).cast("string")
    slug = normalize.product_slug(F.col("title"), F.col("brand"), F.col("asin"), none.cast("double"), none)
    new = with_ids(new, products).withColumn("slug", slug).withColumn("updated_at", as_of)
    after = _upserted(products, new, as_of, ("slug", "category", "parent_asin", "created_at"), ("features", "description", "image_url"))
    priced = new.where("price is not null").withColumn("product_id", F.col("id"))
    prices_after = _priced(prices, priced, [*PRICES, "list_price", "price_min", "price_max", "price_avg_30"], country, currency, FEED, as_of)
    return after, prices_after, _history(priced, F.col("price"), country, currency, as_of)


def import_csv(feed: DataFrame, products: DataFrame, prices: DataFrame, country: str, as_of: Column, currency: str = "EUR") -> tuple[DataFrame, DataFrame]:
    """products and prices after a wide feed: known products take all its values, nulls too, new ones
    get an id, the condition New and as_of as the time they were created; prices only where there is one of the shop or a new one."""
    new = with_ids(feed_csv_products(feed), products).withColumn("updated_at", as_of)
    if "features" in products.columns and products.schema["features"].dataType.simpleString() == "string":
        new = new.withColumn("features", F.to_json("features"))
    after = _upserted(products, new, as_of, ("created_at",))
    priced = new.where((F.coalesce("amazon_price", F.lit(0.0)) > 0) | (F.coalesce("new_price", F.lit(0.0)) > 0)).withColumn("product_id", F.col("id"))
    return after, _priced(prices, priced, [*PRICES, "warehouse_price", "list_price", "price_avg_30", "price_avg_90"], country, currency, FEED, as_of)


def update_metadata(products: DataFrame, feed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """products with the rank, rating and review count of a feed (asin, and what it has of salesRanks,
    rating in tenths, reviews); what the feed lacks keeps its value. With as_of, which is then the time of the update of
    all products that the feed names."""
    brought = {
        "sales_rank": normalize.latest_rank(F.col("salesRanks")) if "salesRanks" in feed.columns else None,
        "rating": F.when(F.col("rating") > 0, F.col("rating") / 10.0) if "rating" in feed.columns else None,
        "review_count": F.col("reviews") if "reviews" in feed.columns else None,
        "updated_at": as_of,
    }
    fresh = {c: v for c, v in brought.items() if v is not None and c in products.columns}
    new = feed.select("asin", *[v.alias(f"_new_{c}") for c, v in fresh.items()])
    rows = products.join(new, "asin", "left")
    return rows.select(*[F.coalesce(F.col(f"_new_{c}").cast(products.schema[c].dataType), F.col(c)).alias(c) if c in fresh else F.col(c) for c in products.columns])


def update_prices(products: DataFrame, prices: DataFrame, feed: DataFrame, country: str, as_of: Column, hours: int = 11, currency: str = "EUR") -> tuple[DataFrame, DataFrame, DataFrame]:
    """products and prices after an update of the stale ones, and history rows of real changes.

    Products that the feed names take its metadata, see update_metadata(). A row without a
    price to buy at (the shop's own, else new) changes no price. The others overwrite the prices, and
    price_per_unit by the product's normalised capacity; a known price that was another one, or none, gives a history row, a
    first price does not. Of several rows of an ASIN one counts, the cheapest.
    """
    before = as_of - F.make_dt_interval(hours=F.lit(hours))
    stale = catalog.stale_prices(products, prices, country, before).select("asin")
    due = feed.join(stale, "asin", "left_semi")
    now = metrics.buyable_price(F.col("amazon_price"), F.col("new_price"))
    first = F.row_number().over(Window.partitionBy("asin").orderBy(now.asc_nulls_last()))
    due = due.withColumn("_n", first).where("_n = 1").drop("_n")
    after = update_metadata(products, due, as_of)
    offered = due.select("asin", *[c for c in (*PRICES, "warehouse_price") if c in due.columns])
    new = catalog.match_feed(offered, products).withColumn("price", now).where("price is not null")
    if "price_per_unit" in prices.columns:
        size = F.col("normalized_capacity") if "normalized_capacity" in products.columns else F.lit(None).cast("double")
        sizes = products.select(F.col("id").alias("product_id"), size.alias("_size"))
        new = new.join(sizes, "product_id").withColumn("price_per_unit", F.when(F.col("_size") > 0, F.col("price") / F.col("_size")))
    known = prices.where(F.col("country") == country).select("product_id", F.coalesce("amazon_price", "new_price").alias("_before"))
    changed = new.join(known, "product_id").where(~F.col("_before").eqNullSafe(F.col("price")))
    prices_after = _priced(prices, new, [*PRICES, "warehouse_price", "price_per_unit"], country, currency, FEED, as_of)
    return after, prices_after, _history(changed, F.col("price"), country, currency, as_of)


def enrichment_candidates(products: DataFrame, most: int = 500) -> DataFrame:
    """Products whose history isn't seeded, unranked ones first, then by rank."""
    return products.where(~F.coalesce("history_seeded", F.lit(False))).orderBy(F.asc_nulls_first("sales_rank"), "id").limit(most)


def enrich(products: DataFrame, feed: DataFrame, most: int = 500) -> DataFrame:
    """Products after the first `most` not yet seeded, best rank first, are matched."""
    new = feed.join(enrichment_candidates(products, most).select("asin"), "asin", "left_semi").select("asin", "price_avg_90", "sales_rank", F.lit(True).alias("history_seeded"))
    return upsert(products, new.select(*[c for c in new.columns if c in products.columns]), ["asin"])


def deploy(local: DataFrame, remote: DataFrame, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The remote products after the local ones went over, and each child table under
    remote ids (rows that can't be mapped keep a status)."""
    top = F.coalesce(remote.select(F.max("id")).scalar(), F.lit(0).cast("long"))
    known = local.join(remote.select("asin", F.col("id").alias("remote_id")), "asin", "left").withColumn("id", F.coalesce("remote_id", F.col("id") + top)).drop("remote_id")
    after = upsert(remote, known.select(remote.columns), ["asin"], [c for c in remote.columns if c not in ("asin", "id")])
    return after, {name: catalog.remap_ids(df, local, after) for name, df in children.items()}


def import_outcome(feed: DataFrame, mapped: DataFrame, products: DataFrame) -> DataFrame:
    """status, n: added, updated and skipped rows of an import."""
    now = catalog.split_new_existing(mapped.select("asin"), products).withColumn("status", F.when(F.col("is_new"), "added").otherwise("updated"))
    skipped = feed.select(F.upper(F.trim("ASIN")).alias("asin")).join(mapped, "asin", "left_anti").withColumn("status", F.lit("skipped"))
    return now.select("status").union(skipped.select("status")).groupBy("status").agg(F.count("*").alias("n"))


def import_summary(mapped: DataFrame, products: DataFrame) -> DataFrame:
    """category, n: new products of an import by category."""
    return catalog.split_new_existing(mapped.select("asin", "category"), products).where("is_new").groupBy("category").agg(F.count("*").alias("n"))


def discovery_candidates(bestsellers: DataFrame, deals: DataFrame, cap: int) -> DataFrame:
    """asin: bestsellers before deals, each once by its first place, `cap` at most."""
    both = bestsellers.select("asin", F.lit(0).alias("list"), "place").union(deals.select("asin", F.lit(1).alias("list"), "place"))
    first = both.groupBy("asin").agg(F.min(F.struct("list", "place")).alias("at"))
    return first.orderBy("at", "asin").limit(cap).select("asin")


def with_slugs(products: DataFrame, name: str = "slug") -> DataFrame:
    """Adds the slugs. Rows are dealt out first: a slug costs far more than reading its row, and few tasks read a small file of many rows."""
    slug = normalize.product_slug(F.col("title"), F.col("brand"), F.col("asin"), F.col("capacity"), F.col("capacity_unit"))
    return products.repartition("asin", "title").withColumn(name, slug)


def regenerated_slugs(products: DataFrame) -> DataFrame:
    """asin, slug, new_slug, changed, collides."""
    rows = with_slugs(products, "new_slug")
    n = F.count("*").over(Window.partitionBy("new_slug"))
    return rows.select("asin", "slug", "new_slug", (~F.col("slug").eqNullSafe(F.col("new_slug"))).alias("changed"), (n > 1).alias("collides"))


def is_stale(df: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return df.agg(F.coalesce(F.max(F.col("last_updated") < as_of - F.make_dt_interval(hours=F.lit(hours))), F.lit(False)).alias("stale"))


def stale_products(products: DataFrame, as_of: Column, most: int) -> DataFrame:
    """The `most` longest untouched products, by the interval for a catalogue of this size."""
    hours = products.select(normalize.refresh_hours(F.count("*")).cast("int")).scalar()
    return products.where(F.col("updated_at") < as_of - F.make_dt_interval(hours=hours)).orderBy("updated_at", "id").limit(most)
