"""Queries that show all that an operator makes, beside those that show a figure of it; and operators that no other query calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting, metrics, normalize
from ..operators import catalog, curation, export, history, listing, merge
from ..sources import dims, testdata
from ..streaming import ticks
from . import ingest
from .queries import _ANALYSIS, _PRICE, as_of
from .registry import ORACLE_SQL, query


def _price() -> Column:
    return metrics.effective_price(F.col("amazon_price"), F.col("new_price"), F.col("used_price"))


def _cents(c: str) -> str:
    return f"cast(round({c} * 100) as bigint)"


@query(
    f"""select product_id, country, points, current, floor(a * 100 + 0.5) / 100 as average, low, high, floor((current - a) / a * 100 * 10 + 0.5) / 10 as pct_from_average, floor((current - low) / low * 100 * 10 + 0.5) / 10 as pct_from_low,
case when (current - low) / low * 100 <= 5 or (current - a) / a * 100 <= -10 then 'great_deal' when (current - a) / a * 100 <= -5 then 'good_price' when (current - a) / a * 100 <= 5 then 'fair' else 'wait' end as recommendation from ({_ANALYSIS}) y"""
)
def whole_price_analysis(spark: SparkSession, sf: str) -> DataFrame:
    buy = metrics.buyable_price(F.col("amazon_price"), F.col("new_price"))
    return history.analyze_prices(testdata.history(spark, sf), testdata.prices(spark, sf), buy, F.lit("2000-08-01").cast("timestamp"), as_of())


@query(
    """select product_id, country, price, recorded_at, l_orderkey, l_linenumber, floor(case when t1 > t0 then (t - t0) / (t1 - t0) else 0 end * 1000000 + 0.5) / 1000000 as x, floor(case when hi > lo then (price - lo) / (hi - lo) else 0 end * 1000000 + 0.5) / 1000000 as y from (
select *, epoch(recorded_at) as t, min(epoch(recorded_at)) over w t0, max(epoch(recorded_at)) over w t1, min(price) over w lo, max(price) over w hi, count(*) over w n from history window w as (partition by product_id, country)) z where n >= 2"""
)
def chart_points(spark: SparkSession, sf: str) -> DataFrame:
    """Places by time and price; millionths are rounded half up, which engines' own round() does not do alike at ties."""
    out = history.chart_series(testdata.history(spark, sf), ["product_id", "country"])
    millionths = lambda c: (F.floor(F.col(c) * 1000000 + 0.5) / 1000000).alias(c)
    return out.select("product_id", "country", "price", "recorded_at", "l_orderkey", "l_linenumber", millionths("x"), millionths("y"))


@query(
    f"""select p.id, coalesce(points, '') as points from products p left join (select product_id, string_agg(strftime(recorded_at, '%Y%m%d') || ':' || {_cents("price")}, ' ' order by recorded_at, price) as points from (
select *, row_number() over (partition by product_id order by recorded_at desc, price desc) as n from history where recorded_at >= cast('2000-01-01' as timestamp)) x where n <= 100 group by product_id) h on p.id = product_id"""
)
def product_series(spark: SparkSession, sf: str) -> DataFrame:
    """The points of a product's page, in order."""
    out = catalog.product_detail(testdata.products(spark, sf), testdata.history(spark, sf), F.lit("2000-01-01").cast("timestamp"))
    point = lambda x: F.concat(F.date_format(x["recorded_at"], "yyyyMMdd"), F.lit(":"), F.round(x["price"] * 100).cast("long").cast("string"))
    return out.select("id", F.coalesce(F.array_join(F.transform("price_history", point), " "), F.lit("")).alias("points"))


@query(
    """select 'https://x/' || folder || '/' || slug as url, cast(lastmod as varchar) as lastmod, changefreq, priority, 'https://x/de/' || folder || '/' || slug as de, 'https://x/en/' || folder || '/' || slug as en, languages from (
select 'p' as folder, asin as slug, cast('2001-08-01' as date) as lastmod, 'daily' as changefreq, 0.8 as priority, 2 as languages from products union all select 'c', category, null, 'daily', 0.9, 2 from (select distinct category from products where category <> 'tvs') c
union all select 'blog', lower(r_name), cast('2001-01-01' as date) + r_regionkey, 'weekly', 0.6, 2 from region) x"""
)
def whole_sitemap(spark: SparkSession, sf: str) -> DataFrame:
    """Products, categories of which one is hidden, and articles, with all columns."""
    p = testdata.products(spark, sf).withColumn("slug", F.col("asin")).withColumn("updated_at", as_of())
    tree = p.select(F.col("category").alias("slug")).distinct().withColumn("hidden", F.col("slug") == "tvs")
    articles = testdata.table(spark, sf, "region").select(F.lower("r_name").alias("slug"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("r_regionkey")).alias("publish_date"))
    at = lambda k: F.col("alternates")[k]
    rows = export.sitemap("https://x", p, tree, articles, ["de", "en"])
    return rows.select("url", F.col("lastmod").cast("string").alias("lastmod"), "changefreq", F.col("priority").cast("decimal(2,1)").alias("priority"), at("de").alias("de"), at("en").alias("en"), F.size("alternates").alias("languages"))


@query(
    f"""select p.id, case when n > 0 or review_count > 0 then title end as name, case when n > 0 or review_count > 0 then asin end as sku, case when n > 0 or review_count > 0 then brand end as brand, case when n > 0 then 'AggregateOffer' end as kind,
case when n > 0 then low end as low, case when n > 0 then high end as high, case when n > 0 then n end as offers, case when n > 0 then case when p.id % 2 = 0 then 'GBP' else 'EUR' end end as currency,
case when review_count > 0 then round(cast(rating as double), 1) end as rating, case when review_count > 0 then review_count end as reviews
from products p left join (select product_id, count({_PRICE}) as n, min({_PRICE}) as low, max({_PRICE}) as high from prices group by product_id) q on p.id = product_id"""
)
def structured_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of each product's document, in two currencies."""
    p = testdata.products(spark, sf)
    built = catalog.build_products(p, testdata.prices(spark, sf), _price())
    doc = export.product_jsonld(p.join(listing.price_range(built), "id").withColumn("currency", F.when(F.col("id") % 2 == 0, "GBP")))
    at = lambda path: F.get_json_object("jsonld", f"$.{path}")
    return doc.select(
        "id", at("name").alias("name"), at("sku").alias("sku"), at("brand.name").alias("brand"), F.get_json_object("jsonld", "$.offers['@type']").alias("kind"),
        at("offers.lowPrice").cast("double").alias("low"), at("offers.highPrice").cast("double").alias("high"), at("offers.offerCount").cast("long").alias("offers"), at("offers.priceCurrency").alias("currency"),
        F.round(at("aggregateRating.ratingValue").cast("double"), 1).alias("rating"), at("aggregateRating.reviewCount").cast("long").alias("reviews"),
    )


@query(
    """select id, case when id % 2 = 0 then 'static ' else 'paapi ' end || title as title, case when id % 3 = 0 and id % 2 = 1 then 'paapi' when id % 2 = 0 then 'static' else 'paapi' end as brand, case when id % 2 = 0 then cast('2001-07-20' as date) else cast('2001-07-01' as date) end as last_updated,
round(case when id % 2 = 0 then list_price * 0.9 else list_price end, 6) as best_price, case when id % 2 = 0 then 'static' else 'paapi' end as best_source,
'paapi' || case when id % 2 = 0 then ',static' else '' end || case when id % 3 = 0 then ',feed' else '' end as sources,
'paapi:' || cast(round(list_price * 100) as bigint) || case when id % 2 = 0 then ',static:' || cast(round(list_price * 90) as bigint) else '' end || case when id % 3 = 0 then ',feed:' || cast(round(list_price * 110) as bigint) else '' end as offers from products"""
)
def merged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All that a merge of three sources keeps: the newest fields, the best offer, all offers and sources in order."""
    p = testdata.products(spark, sf).select("id", "title", "list_price")
    src = lambda df, name, f, day: df.select("id", F.concat(F.lit(f"{name} "), "title").alias("title"), F.lit(name).alias("brand"), (F.col("list_price") * f).alias("price"), F.lit(name).alias("source"), F.lit(day).cast("date").alias("last_updated"))
    parts = [src(p, "paapi", F.lit(1.0), "2001-07-01"), src(p.where("id % 2 = 0"), "static", F.lit(0.9), "2001-07-20"), src(p.where("id % 3 = 0"), "feed", F.lit(1.1), "2001-06-01")]
    out = merge.merge_sources(parts, ["title", "brand"])
    offers = F.transform("offers", lambda o: F.concat(o["source"], F.lit(":"), F.round(o["price"] * 100).cast("long").cast("string")))
    return out.select("id", "title", "brand", "last_updated", F.round("best_price", 6).alias("best_price"), "best_source", F.array_join("sources", ",").alias("sources"), F.array_join(offers, ",").alias("offers"))


@query(
    """select id, case when id % 3 = 0 then 'Alpha/' || round(list_price * 2, 2) || '/1.5 Shop/' || round(list_price, 2) || '/0.0' else 'Amazon/' || round(list_price, 2) || '/0.0' end as offers from products"""
)
def all_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Two offers for a third of the products, the shop's own price for the rest."""
    p = testdata.products(spark, sf).withColumn("price", F.round("list_price", 2))
    one = lambda name, factor, shipping: p.where("id % 3 = 0").select(F.col("id").alias("product_id"), F.lit(name).alias("merchant_name"), F.round(F.col("list_price") * factor, 2).alias("price"), F.lit(shipping).alias("shipping_cost"))
    out = catalog.offers_or_default(p, one("Shop", 1, 0.0).union(one("Alpha", 2, 1.5)))
    text = F.transform("offers", lambda o: F.concat_ws("/", o["merchant_name"], o["price"].cast("string"), o["shipping_cost"].cast("string")))
    return out.select("id", F.array_join(text, " ").alias("offers"))


# ---- operators that no other query calls


@query(
    f"""select p.id, case when q.country is not null then price end as price, case when price is not null then q.last_updated end as last_updated from products p left join (select product_id, country, {_PRICE} as price, last_updated from prices where country = 'fr') q on p.id = product_id"""
)
def localized_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Products with the price of one country, by its upper-case code."""
    built = catalog.build_products(testdata.products(spark, sf).select("id"), testdata.prices(spark, sf), _price())
    out = catalog.localize(built, "FR")
    return out.select("id", "price", F.when(F.col("price").isNotNull(), F.col("last_updated")).alias("last_updated"))


@query("select country, max(last_updated < cast('2001-07-31 00:00:00' as timestamp)) as stale from prices group by country")
def stale_countries(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a country has a price older than a day."""
    prices = testdata.prices(spark, sf)
    each = [ingest.is_stale(prices.where(F.col("country") == c), as_of()).withColumn("country", F.lit(c)) for c in ("us", "uk", "de", "fr", "es")]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.join(prices.select("country").distinct(), "country", "left_semi")


_CPU_TITLE = "'CPU ' || id || case id % 5 when 0 then ' AM5 16-Core' when 1 then ' lga 1700 8 Kerne' when 2 then ' sTRX4' when 3 then ' 12 core AM4' else '' end"


@query(
    f"""select id, case when id % 7 = 0 then 'SP5' else upper(replace(nullif(regexp_extract(title, '(AM[45]|LGA\\s?[0-9]{{4}}|sTRX4|sWRX8)', 1, 'i'), ''), ' ', '')) end as socket,
coalesce(case when id % 11 = 0 then '64' end, nullif(regexp_extract(title, '([0-9]+)\\s?-?\\s?(Core|Kerne)', 1, 'i'), '')) as cores from (select id, {_CPU_TITLE} as title from products where category = 'cpu') x"""
)
def cpu_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Socket and cores by the specifications, else the title."""
    p = testdata.products(spark, sf).where("category = 'cpu'").select("id", F.expr(_CPU_TITLE).alias("title"))
    specs = F.map_from_entries(F.filter(F.array(F.when(F.col("id") % 7 == 0, F.struct(F.lit("Socket"), F.lit("SP5"))), F.when(F.col("id") % 11 == 0, F.struct(F.lit("Cores"), F.lit("64")))), lambda e: e.isNotNull()))
    facts = normalize.cpu_attributes(F.col("title"), specs)
    return p.select("id", facts["socket"].alias("socket"), facts["cores"].alias("cores"))


_EXTRAS = ["", " SSD NVMe M.2 2280", " 7.450 MB/s lesen", " Gaming PC 80 Plus Gold Netzteil", " (Renewed)", " für Gaming und Videobearbeitung", " Interne Festplatte PCIe 4.0", " a very long name that goes on and on without any end"]
_NOISY = "brand || ' ' || title || case id % 8 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(_EXTRAS)) + " end"


def _slug_sql(title: str, rows: str) -> str:
    """Slugs by the rule, on DuckDB: brand twice in front counts once; noise goes; cut at the last dash before the 45th letter."""
    clean = "low"
    for n in normalize.NOISE:
        clean = f"regexp_replace({clean}, '\\b(?:{n})\\b', ' ', 'g')"
    dashed = "regexp_replace(regexp_replace({}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    return f"""select id, title, asin, slug from (
select id, title, asin, regexp_replace(regexp_replace(case when contains(cut, size) then cut else cut || '-' || size end || '-' || lower(right(asin, 4)), '-+', '-', 'g'), '^-|-$', '', 'g') as slug from (
select *, case when length(base) <= 45 then base when contains(left(base, 45), '-') and length(left(base, 45)) - instr(reverse(left(base, 45)), '-') > 20 then left(base, length(left(base, 45)) - instr(reverse(left(base, 45)), '-')) else left(base, 45) end as cut from (
select *, case when starts_with(words, prefix) then words else prefix || '-' || words end as base from (
select *, {dashed.format(clean)} as words, regexp_replace(b, '[^a-z0-9]+', '-', 'g') as prefix, cast(cast(capacity as bigint) as varchar) || lower(capacity_unit) as size from (
select *, case when starts_with(lower(title), b || ' ' || b || ' ') then substr(lower(title), length(b) + 2) else lower(title) end as low from (
select id, asin, capacity, capacity_unit, lower(brand) as b, {title} as title from {rows}) t1) t2) t3) t4) t5) t6"""


@query(_slug_sql(_NOISY, "products"))
def noisy_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs of titles with the brand twice, noise of many kinds, and too many words."""
    p = testdata.products(spark, sf).withColumn("title", F.expr(_NOISY))
    return ingest.with_slugs(p).select("id", "title", "asin", "slug")


@query(
    f"""select asin, old_slug as slug, slug as new_slug, old_slug is distinct from slug as changed, count(*) over (partition by slug) > 1 as collides from (select *, case when id % 2 = 0 then slug end as old_slug from ({_slug_sql("'Drive X' || (id % 40)", "(select id, brand, 'B' || (id % 3) || '00' as asin, 4 as capacity, 'TB' as capacity_unit from products) q")}) s) z"""
)
def slug_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs made anew for products that look alike: which change, and which are not unique."""
    p = testdata.products(spark, sf).select("id", "brand", F.concat(F.lit("B"), (F.col("id") % 3).cast("string"), F.lit("00")).alias("asin"), F.concat(F.lit("Drive X"), (F.col("id") % 40).cast("string")).alias("title"), F.lit(4.0).alias("capacity"), F.lit("TB").alias("capacity_unit"))
    old = normalize.product_slug(F.col("title"), F.col("brand"), F.col("asin"), F.col("capacity"), F.col("capacity_unit"))
    return ingest.regenerated_slugs(p.withColumn("slug", F.when(F.col("id") % 2 == 0, old)))


@query(
    """with recursive ordered as (select user_id as product_id, value as price, ts, row_number() over (partition by user_id order by ts, event_id) as n from events where ts is not null and value is not null),
taken as (select *, ts as last from ordered where n = 1 union all
  select o.product_id, o.price, o.ts, o.n, case when o.ts >= t.last + interval 23 hours then o.ts else t.last end from taken t join ordered o on o.product_id = t.product_id and o.n = t.n + 1)
select product_id, price, ts from taken where last = ts and not exists (select 1 from taken b where b.product_id = taken.product_id and b.n = taken.n - 1 and b.last = taken.last)""",
    derived=False,
)
def tick_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """One tick of a product in 23 hours."""
    out = ticks.snapshots(ticks.as_ticks(testdata.table(spark, sf, "events")))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """select product_id, old_price, price, ts from (select user_id as product_id, lag(value) over w as old_price, value as price, ts, lag(ts) over w as before from events where ts is not null and value is not null window w as (partition by user_id order by ts, event_id)) x
where old_price <> price and ts < before + interval 2 days""",
    derived=False,
)
def tick_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between ticks that are less than two days apart."""
    out = ticks.price_changes(ticks.as_ticks(testdata.table(spark, sf, "events")), 2)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    f"""select id, country, coalesce(format('{{:,.2f}}', price), null) as plain, case when price is not null then translate(format('{{:,.1f}}', price), ',.', '.,') end as comma, coalesce(format('{{:,.1f}}', price / 10) || '%', '–') as percent
from (select id, country, {_PRICE} as price from products join prices on id = product_id) x"""
)
def formatted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.join_prices(testdata.products(spark, sf), testdata.prices(spark, sf)).withColumn("price", _price())
    return rows.select("id", "country", formatting.format_number(F.col("price")).alias("plain"), formatting.format_number(F.col("price"), 1, F.lit(True)).alias("comma"), formatting.format_percent(F.col("price") / 10).alias("percent"))


@query()
def home_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The front pages of all countries at once."""
    return curation.home_pages(testdata.products(spark, sf), testdata.prices(spark, sf), "age_days")


@query(
    f"""select p.id, coalesce(prices, '') as prices, coalesce(avg30, '') as avg30, coalesce(avg90, '') as avg90, coalesce(updated, '') as updated from products p left join (select product_id,
string_agg(case when price is not null then country || '=' || {_cents("price")} end, ',' order by country) as prices, string_agg(case when price_avg_30 is not null then country || '=' || {_cents("price_avg_30")} end, ',' order by country) as avg30,
string_agg(case when price_avg_90 is not null then country || '=' || {_cents("price_avg_90")} end, ',' order by country) as avg90, string_agg(country || '=' || strftime(last_updated, '%Y%m%d'), ',' order by country) as updated
from (select *, {_PRICE} as price from prices) x group by product_id) q on p.id = product_id"""
)
def product_maps(spark: SparkSession, sf: str) -> DataFrame:
    """All four maps of a product, by country."""
    built = catalog.build_products(testdata.products(spark, sf).select("id"), testdata.prices(spark, sf), _price())

    def text(c: str, value) -> Column:
        entries = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))
        return F.coalesce(F.array_join(entries, ","), F.lit(""))

    cents = lambda v: F.round(v * 100).cast("long").cast("string")
    day = lambda v: F.date_format(v, "yyyyMMdd")
    columns = {"prices": ("prices_by_country", cents), "avg30": ("price_avg_30_by_country", cents), "avg90": ("price_avg_90_by_country", cents), "updated": ("prices_last_updated_by_country", day)}
    return built.select("id", *[text(c, v).alias(name) for name, (c, v) in columns.items()])


_LISTING = ORACLE_SQL["category_listing"].removeprefix(testdata.CTES)
_SORTS = {
    "price": "price", "pricePerUnit": "unit_price", "price-per-unit": "unit_price", "savings": "savings desc", "newest": "age_days", "popular": "score desc", "capacity": "size",
}


@query(
    f""", listed as ({_LISTING}), sized as (select l.*, age_days, capacity * case when capacity_unit = 'TB' then 1000e0 else 1e0 end / case when l.category in ('hard-drives', 'ssds') or (l.category not in ('ram', 'cpu') and capacity_unit = 'TB') then 1000e0 else 1e0 end as size from listed l join products p on p.id = l.id)
select sort, id, place from ("""
    + " union all ".join(f"select '{n}' as sort, id, row_number() over (order by {o} nulls last, id) as place from sized" for n, o in _SORTS.items())
    + ") x where place <= 20"
)
def sorted_listings(spark: SparkSession, sf: str) -> DataFrame:
    """The first page in each of the orders of a list."""
    rows = listing.localized_listing(testdata.products(spark, sf), testdata.prices(spark, sf), dims.categories(spark), "de")
    rows = rows.withColumns({"price": F.round("price", 2), "savings": F.round("savings", 6), "score": F.round("score", 3), "created_at": F.date_sub(F.lit("2001-08-01").cast("date"), F.col("age_days").cast("int"))})
    return listing.first_pages(rows)
