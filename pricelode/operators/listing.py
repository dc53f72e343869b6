"""Filters, facets, rankings and pages of product lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions import metrics as M
from ..functions.normalize import cpu_attributes
from ..functions.semantics import filled
from . import blocks
from .search import contains_any_word


@dataclass
class FilterParams:
    search: str | None = None
    values: dict[str, list] = field(default_factory=dict)  # column -> allowed values
    min_price: float | None = None
    max_price: float | None = None
    min_capacity: float | None = None
    max_capacity: float | None = None


def facet_filter(df: DataFrame, p: FilterParams, capacity: str = "normalized_capacity") -> DataFrame:
    """Rows that meet every given filter; a price of 0 or none fails a price filter."""
    tests: list[Column] = []
    if p.search:
        tests.append(F.lower("title").contains(p.search.lower()))
    tests += [F.col(c).isin(v) for c, v in p.values.items() if v]
    price = F.coalesce("price", F.lit(0.0))
    if p.min_price is not None:
        tests.append(price >= p.min_price)
    if p.max_price is not None:
        tests.append((price > 0) & (price <= p.max_price))
    if p.min_capacity is not None:
        tests.append(F.col(capacity) >= p.min_capacity)
    if p.max_capacity is not None:
        tests.append(F.col(capacity) <= p.max_capacity)
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def apply_filters(df: DataFrame, filters: dict, matcher: Callable[[str, object], Column]) -> DataFrame:
    """Keeps what meets matcher(name, value) of every filter that is not empty."""
    for name, value in filters.items():
        if value not in (None, "", [], {}):
            df = df.where(matcher(name, value))
    return df


def active_filters(filters: dict) -> int:
    return sum(v not in (None, "", [], {}) for v in filters.values())


def by_brand(df: DataFrame, brand: str, exclude: str | None = None) -> DataFrame:
    out = df.where(F.lower("brand") == brand.lower())
    return out if exclude is None else out.where(F.col("slug") != exclude)


def only_new(df: DataFrame) -> DataFrame:
    low = F.lower("title")
    return df.where((F.col("condition") == "New") & ~(low.contains("renewed") | low.contains("refurbished") | low.contains("generalüberholt") | low.contains("erneuert")))


def deal_candidates(rows: DataFrame) -> DataFrame:
    positive = lambda a, b: (F.coalesce(a, F.lit(0.0)) > 0) | (F.coalesce(b, F.lit(0.0)) > 0)
    return rows.where(positive("price_avg_90", "price_avg_30") & positive("amazon_price", "new_price"))


def best_deals_by_country(products: DataFrame, prices: DataFrame, new_only: bool = True) -> DataFrame:
    """Products and prices of deals with drop, the relative drop below the 90 (else 30) day average."""
    rows = products.join(deal_candidates(prices), products["id"] == prices["product_id"])
    rows = only_new(rows) if new_only else rows
    ref, now = F.coalesce("price_avg_90", "price_avg_30"), F.coalesce("amazon_price", "new_price")
    return rows.withColumn("drop", F.try_divide(ref - now, ref))


def best_deals(products: DataFrame, prices: DataFrame, country: str, k: int | None, new_only: bool = True) -> DataFrame:
    """Largest relative drop below the 90 (else 30) day average."""
    ranked = best_deals_by_country(products, prices.where(F.col("country") == country), new_only).orderBy(F.desc_nulls_last("drop"), "id")
    return ranked.limit(k) if k else ranked


def popularity() -> list[Column]:
    return [F.coalesce("sales_rank", F.lit(10_000_000)).asc(), F.desc_nulls_last("review_count")]


def diverse_popular(products: DataFrame, n: int = 15) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("category").orderBy(*popularity(), F.col("id")))
    return only_new(products).withColumn("place", place).where(F.col("place") <= n)


def most_popular(products: DataFrame, k: int) -> DataFrame:
    return products.orderBy(*popularity(), F.desc_nulls_last("rating"), "id").limit(k)


def fallback_search(products: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """query_id, id, place: for each query (query_id, query) the first k products by id whose
    title holds any of its words. Any number of queries; see search.contains_any_word(). A query's first k
    products are among the first k of each of its words, so only these meet the queries."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower(F.trim("query")), r"\s+"))).alias("word")).where("word <> ''")
    first = F.row_number().over(Window.partitionBy("word").orderBy("id"))
    hits = contains_any_word(products, words).withColumn("_n", first).where(F.col("_n") <= k).join(words.hint("merge"), "word")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return hits.select("query_id", "id").distinct().withColumn("place", place).where(F.col("place") <= k)


def new_arrivals(products: DataFrame, k: int, created: str = "created_at") -> DataFrame:
    return products.orderBy(F.desc_nulls_last(created), "id").limit(k)


def recent_slugs(products: DataFrame, k: int = 100, updated: str = "updated_at") -> DataFrame:
    return products.orderBy(F.desc_nulls_last(updated), "id").limit(k)


def hub_bestsellers(rows: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Most priced countries first, then brand; for each value of `by` if that is given."""
    order = [F.desc("n_countries"), F.lower("brand").asc(), F.col("brand").asc(), F.col("id").asc()]
    if by is None:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def hub_deals(rows: DataFrame, k: int) -> DataFrame:
    """Cheapest by unit price, those without one behind, by price."""
    unit = F.col("unit_price")
    return rows.where("price > 0").orderBy(unit.isNull(), F.coalesce(unit, F.col("price")), "id").limit(k)


def quick_picks(rows: DataFrame, k: int = 3) -> DataFrame:
    return rows.where("unit_price is not null").orderBy("unit_price", "id").limit(k)


SORTS = {"price": "price", "pricePerUnit": "unit_price", "price-per-unit": "unit_price", "savings": "savings", "newest": "created_at", "popular": "score", "capacity": "normalized_capacity"}

FALLING = ("newest", "savings", "popular")


def sort_listing(df: DataFrame, sort: str, descending: bool | None = None) -> DataFrame:
    """Missing values come last; ties by id. newest, savings and popular fall by default."""
    down = sort in FALLING if descending is None else descending
    c = F.col(SORTS[sort])
    return df.orderBy(c.desc_nulls_last() if down else c.asc_nulls_last(), "id")


def first_pages(df: DataFrame, k: int = 20) -> DataFrame:
    """sort, id, place: the first k rows in each order of sort_listing(). The list is worked out once for all of
    them; each task keeps its own first k."""

    def value(name: str) -> Column:
        c = F.col(SORTS[name])
        number = (F.unix_date(c) if isinstance(df.schema[SORTS[name]].dataType, DateType) else c).cast("double")
        return F.struct(F.lit(name).alias("sort"), (-number if name in FALLING else number).alias("value"))

    rows = df.select("id", F.explode(F.array(*[value(name) for name in SORTS])).alias("at")).select("id", "at.sort", "at.value")
    place = F.row_number().over(Window.partitionBy("sort").orderBy(F.asc_nulls_last("value"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("sort", "id", "place")


def paginate(df: DataFrame, page: int, size: int = 24) -> DataFrame:
    return df.offset((page - 1) * size).limit(size)


def all_pages(df: DataFrame, by: str, order: list[Column], size: int = 24, coarse: Column | None = None) -> DataFrame:
    """`df` with page, the page of each row within its group.

    `coarse` is a whole number that never falls along `order` (bands of prices, months). With
    it rows are numbered within (by, coarse), and what comes before a band is added from the
    table of counts, so a group that holds a third of all rows is dealt over many tasks.
    """
    if coarse is None:
        n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        return df.withColumn("page", (F.floor((n - 1) / size) + 1).cast("int"))
    rows = df.withColumn("_band", coarse)
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    counted = rows.groupBy(F.col(by).alias("_by"), F.col("_band").alias("_at")).agg(F.count("*").alias("_n"))
    starts = counted.select("_by", "_at", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_band").orderBy(*order)))
    placed = numbered.join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_band").eqNullSafe(F.col("_at")))
    page = (F.floor((F.col("_start") + F.col("_place") - 1) / size) + 1).cast("int")
    return placed.withColumn("page", page).drop("_band", "_by", "_at", "_start", "_place")


def price_band(price: Column) -> Column:
    """A band that rises with the price: 16 to each doubling, 0 for 1 cent and less."""
    return F.floor(F.greatest(F.log2(F.greatest(price, F.lit(0.01)) * 100), F.lit(0.0)) * 16).cast("int")


def listing_summary(df: DataFrame, filtered: DataFrame, size: int = 24) -> DataFrame:
    """One row: total, oldest, filtered, pages."""
    left = filtered.select(F.count("*")).scalar()
    rows = df.agg(F.count("*").alias("total"), F.min("last_updated").alias("oldest")).withColumn("filtered", left)
    return rows.withColumn("pages", F.ceil(F.col("filtered") / size))


def facet_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value: the distinct comma-separated values of the columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    rows = df.select(F.explode(pairs).alias("p")).select("p.field", F.explode(F.split("p.v", ",")).alias("value"))
    return rows.select("field", filled(F.trim("value")).alias("value")).where("value is not null").distinct()


def hub_counts(rows: DataFrame, categories: DataFrame, rollup: bool = False) -> DataFrame:
    """Priced products for each parent, and for each category with rollup."""
    tree = F.broadcast(categories.where(~F.coalesce("hidden", F.lit(False))).select(F.col("slug").alias("category"), "parent"))
    joined = rows.where("price > 0").join(tree, "category")
    grouped = joined.rollup("parent", "category") if rollup else joined.groupBy("parent")
    return grouped.agg(F.count("*").alias("n"))


def unit_badges(df: DataFrame, by: str) -> DataFrame:
    """badge: Best Price at the lowest unit price, Good Deal below 0.85 of the average. A
    category's two figures are partial aggregates joined back, no window over all of it."""
    u = F.col("unit_price")
    figures = df.groupBy(by).agg(F.min(u).alias("_low"), F.avg(u).alias("_mean"))
    badge = F.when(u == F.col("_low"), "Best Price").when(u < 0.85 * F.col("_mean"), "Good Deal")
    return df.join(figures, by, "left").withColumn("badge", badge).drop("_low", "_mean")


def price_range(df: DataFrame) -> DataFrame:
    v = F.map_values("prices_by_country")
    return df.select("id", F.array_min(v).alias("low"), F.array_max(v).alias("high"), F.coalesce(F.nullif(F.size(v), F.lit(-1)), F.lit(0)).alias("n_prices"))


def rank_offers(offers: DataFrame) -> DataFrame:
    """place by price, the best first (merchant on ties); and the total with shipping."""
    total = F.col("price") + F.coalesce("shipping_cost", F.lit(0.0))
    order = Window.partitionBy("product_id").orderBy("price", "merchant_name")
    return offers.withColumn("total_price", total).withColumn("place", F.row_number().over(order))


def localized_listing(products: DataFrame, prices: DataFrame, categories: DataFrame, country: str, category: str | None = None) -> DataFrame:
    """Priced products of a country with unit price, savings, score and CPU facts."""
    base = products if category is None else products.where(F.col("category") == category)
    p = prices.where(F.col("country") == country)
    tree = F.broadcast(categories.select(F.col("slug").alias("category"), "unit_type"))
    rows = base.join(p, base["id"] == p["product_id"]).drop("product_id").join(tree, "category", "left")
    price = M.effective_price(F.col("amazon_price"), F.col("new_price"), F.col("used_price"))
    ref = M.reference_price(F.col("price_avg_90"), F.col("price_avg_30"))
    rows = rows.withColumn("price", price).where("price > 0")
    target = F.coalesce("unit_type", "capacity_unit", F.lit("GB"))
    score = M.desirability(F.col("price"), F.col("title"), F.col("brand"), F.col("category"), F.col("monthly_sold"), F.col("sales_rank"), F.col("rating"), F.col("review_count"))
    specs = F.col("specs") if "specs" in products.columns else F.create_map().cast("map<string,string>")
    return (
        rows.withColumn("unit_price", M.price_per_unit(F.col("price"), F.col("capacity"), F.col("capacity_unit"), F.col("unit_type")))
        .withColumn("normalized_capacity", M.normalized_capacity(F.col("capacity"), F.col("capacity_unit"), target))
        .withColumn("reference", ref).withColumn("savings", M.savings(F.col("price"), ref)).withColumn("score", score["score"])
        .withColumn("cpu", F.when(F.col("category") == "cpu", cpu_attributes(F.col("title"), specs)))
    )


def category_page(listing: DataFrame, params: FilterParams, sort: str, page: int, size: int = 24) -> tuple[DataFrame, DataFrame]:
    """The rows of one page, and the summary."""
    kept = facet_filter(listing, params)
    return paginate(sort_listing(kept, sort), page, size), listing_summary(listing, kept, size)


def similar_products(rows: DataFrame, k: int = 4, block_rows: int = blocks.ROWS) -> DataFrame:
    """id, other_id, place: the k products of the category nearest in price (ties by id).

    The k nearest lie among the k distinct prices on either side, and of one price only
    the k+1 lowest ids can count; so each product meets (2k+1)(k+1) others at most,
    however large its category. Distinct prices are cut into ranges of about `block_rows`, to which the k prices beyond
    either end are added, so no window holds a whole category.
    """
    at_price = Window.partitionBy("category", "price").orderBy("id")
    ids = rows.select("category", "price", "id").withColumn("_n", F.row_number().over(at_price)).where(F.col("_n") <= k + 1)
    steps = ids.groupBy("category", "price").agg(F.collect_list("id").alias("ids"))
    ranges = blocks.with_borders(blocks.with_blocks(steps, ["category"], "price", block_rows), ["category"], ["price"], k)
    around = Window.partitionBy("category", "_block").orderBy("price").rowsBetween(-k, k)
    near = ranges.withColumn("near", F.collect_list(F.struct("price", "ids")).over(around)).where("not _border").select("category", "price", "near")
    pairs = rows.select("id", "category", "price").join(near, ["category", "price"]).select("id", "price", F.explode("near").alias("p"))
    pairs = pairs.select("id", F.abs(F.col("p.price") - F.col("price")).alias("distance"), F.explode("p.ids").alias("other_id")).where("id <> other_id")
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


LITE = ["id", "asin", "slug", "title", "brand", "category", "image_url", "price", "unit_price", "savings", "rating", "review_count", "condition"]


def lite(df: DataFrame, columns: list[str] = LITE) -> DataFrame:
    """The columns that a list shows; others are never read."""
    return df.select(*[c for c in columns if c in df.columns])


def with_price(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("price", F.lit(0.0)) > 0)


def hub_new(rows: DataFrame, k: int, created: str = "created_at") -> DataFrame:
    return new_arrivals(with_price(rows), k, created)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n for each table."""
    return reduce(DataFrame.union, [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()])
