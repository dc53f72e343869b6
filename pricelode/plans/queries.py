"""Queries of the price library over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting, metrics, normalize
from ..functions.semantics import half_up
from ..operators import catalog, curation, daily, export, history, listing, merge, search
from ..sources import dims, testdata
from ..sources.tables import scratch
from ..sources.writers import upsert
from ..streaming import ticks as streaming
from . import ingest
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from .registry import query as _query

def as_of() -> Column:
    return F.lit("2001-08-01").cast("timestamp")


def _priced(spark: SparkSession, sf: str, country: str | None = "de") -> DataFrame:
    rows = catalog.join_prices(testdata.products(spark, sf), testdata.prices(spark, sf), country)
    return rows.withColumn("price", metrics.effective_price(F.col("amazon_price"), F.col("new_price"), F.col("used_price")))


_PRICE = "coalesce(nullif(amazon_price, 0), nullif(new_price, 0), nullif(used_price, 0))"
_NEW = "condition = 'New' and lower(title) not like '%renewed%' and lower(title) not like '%refurbished%'"
_UNITS = "(values ('hard-drives', 'TB'), ('ssds', 'TB'), ('ram', 'GB'), ('cpu', 'core'), ('tvs', null), ('monitors', null)) c(slug, unit)"
_UNIT_PRICE = (
    "floor(price / (capacity * case when capacity_unit = 'TB' then 1000e0 else 1e0 end / case when coalesce(unit, capacity_unit) = 'TB' then 1000e0 else 1e0 end) * 100 + 0.5) / 100"
)


@_query(
    f"""select id, asin, round((coalesce(price_avg_90, price_avg_30) - coalesce(amazon_price, new_price)) / coalesce(price_avg_90, price_avg_30), 6) as price_drop
from products join prices on id = product_id where country = 'de' and {_NEW}
and (coalesce(price_avg_90, 0) > 0 or coalesce(price_avg_30, 0) > 0) and (coalesce(amazon_price, 0) > 0 or coalesce(new_price, 0) > 0)
order by (coalesce(price_avg_90, price_avg_30) - coalesce(amazon_price, new_price)) / coalesce(price_avg_90, price_avg_30) desc nulls last, id limit 80"""
)
def best_deals(spark: SparkSession, sf: str) -> DataFrame:
    top = listing.best_deals(testdata.products(spark, sf), testdata.prices(spark, sf), "de", 80)
    return top.select("id", "asin", F.round("drop", 6).alias("price_drop"))


@_query(f"select id, country, {_PRICE} as price from products join prices on id = product_id")
def effective_prices(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf, None).select("id", "country", "price")


@_query("select product_id, country, price_type, price from (select *, row_number() over (partition by product_id, country, price_type order by recorded_at desc, price desc) rn from history) x where rn = 1")
def latest_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.latest_history(testdata.history(spark, sf)).select("product_id", "country", "price_type", "price")


@_query(
    f"""select p.id, count({_PRICE}) as n_prices, min({_PRICE}) as low, max({_PRICE}) as high from products p left join prices on p.id = product_id group by p.id"""
)
def product_price_maps(spark: SparkSession, sf: str) -> DataFrame:
    price = metrics.effective_price(F.col("amazon_price"), F.col("new_price"), F.col("used_price"))
    built = catalog.build_products(testdata.products(spark, sf).select("id"), testdata.prices(spark, sf), price)
    return listing.price_range(built).select("id", F.col("n_prices").cast("long").alias("n_prices"), "low", "high")


@_query(f"select id, category, country, price, {_UNIT_PRICE} as unit_price from (select id, category, country, capacity, capacity_unit, {_PRICE} as price from products join prices on id = product_id) x join {_UNITS} on slug = category where price > 0")
def unit_prices(spark: SparkSession, sf: str) -> DataFrame:
    tree = F.broadcast(dims.categories(spark).select(F.col("slug").alias("category"), "unit_type"))
    rows = _priced(spark, sf, None).where("price > 0").join(tree, "category")
    unit = metrics.price_per_unit(F.col("price"), F.col("capacity"), F.col("capacity_unit"), F.col("unit_type"))
    return rows.select("id", "category", "country", "price", unit.alias("unit_price"))


@_query(
    f"""select id, category, round(price, 2) as price, {_UNIT_PRICE} as unit_price,
round(case when coalesce(nullif(price_avg_90, 0), nullif(price_avg_30, 0)) > price then 1 - price / coalesce(nullif(price_avg_90, 0), nullif(price_avg_30, 0)) else 0 end, 6) as savings,
round(pow(price, case when price > 400 then 1.7 else 1.5 end) * monthly_sold / 15000
 + case when sales_rank < 100 then 500 when sales_rank < 1000 then 250 when sales_rank < 5000 then 100 when sales_rank < 20000 then 30 else 0 end
 + case when rating >= 4.5 then 50 else 0 end + case when review_count > 1000 then 50 when review_count > 100 then 20 else 0 end
 + case when regexp_matches(lower(title), 'oled|mini-led|8k|neo qled') then 3000 when regexp_matches(lower(title), 'qled|pro|ultra') then 1000
   when category in ('tvs', 'cpu') and regexp_matches(lower(title), 'led|60hz|lcd|ips|1080p|hdtv') then -2000 else 0 end, 3) as score
from (select *, {_PRICE} as price from products join prices on id = product_id where country = 'de') x join {_UNITS} on slug = category where price > 0"""
)
def category_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing.localized_listing(testdata.products(spark, sf), testdata.prices(spark, sf), dims.categories(spark), "de")
    return rows.select("id", "category", F.round("price", 2).alias("price"), "unit_price", F.round("savings", 6).alias("savings"), F.round("score", 3).alias("score"))


@_query(
    f"""select id, category, place from (select id, category, row_number() over (partition by category order by coalesce(sales_rank, 10000000), review_count desc nulls last, id) as place
from products where {_NEW}) x where place <= 15"""
)
def top_per_category(spark: SparkSession, sf: str) -> DataFrame:
    return listing.diverse_popular(testdata.products(spark, sf)).select("id", "category", "place")


@_query("select id from products order by coalesce(sales_rank, 10000000), review_count desc, rating desc, id limit 50")
def most_popular(spark: SparkSession, sf: str) -> DataFrame:
    return listing.most_popular(testdata.products(spark, sf), 50).select("id")


@_query("select id from products order by age_days desc, id limit 60")
def new_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return listing.new_arrivals(testdata.products(spark, sf), 60, "age_days").select("id")


_ANALYSIS = f"""select *, round((current - a) / a * 100, 1) as pa from (
select h.product_id, h.country, count(*) as points, cast(sum(cast(round(price * 100) as bigint)) as double) / (100e0 * count(price)) as a, min(price) as low, max(price) as high, max(cur) as current from history h
join (select product_id as pid, country as c, {_PRICE.replace("coalesce(nullif(amazon_price, 0), nullif(new_price, 0), nullif(used_price, 0))", "nullif(coalesce(amazon_price, new_price), 0)")} as cur from prices) p on pid = h.product_id and c = h.country
where price_type = 'amazon' and recorded_at > cast('2000-08-01' as timestamp) and recorded_at <= cast('2001-08-01' as timestamp) and cur is not null group by h.product_id, h.country having count(*) >= 2) x"""


_ANALYZED = (
    f"""select product_id, country, points, low, high, round(floor(a * 100 + 0.5) / 100, 2) as average,
case when (current - low) / low * 100 <= 5 or (current - a) / a * 100 <= -10 then 'great_deal' when (current - a) / a * 100 <= -5 then 'good_price'
 when (current - a) / a * 100 <= 5 then 'fair' else 'wait' end as recommendation from ({_ANALYSIS}) y"""
)


@_query(_ANALYZED)
def price_analysis(spark: SparkSession, sf: str) -> DataFrame:
    buy = metrics.buyable_price(F.col("amazon_price"), F.col("new_price"))
    out = history.analyze_prices(testdata.history(spark, sf), testdata.prices(spark, sf), buy, F.lit("2000-08-01").cast("timestamp"), as_of())
    return out.select("product_id", "country", "points", "low", "high", F.round("average", 2).alias("average"), "recommendation")


def _daily(spark: SparkSession, sf: str) -> daily.BucketTable:
    """Daily figures of the history, loaded in three batches, the second one twice."""
    table, points = daily.daily_table(scratch(spark, "daily"), 16), testdata.history(spark, sf)
    for name, part in (("a", "l_orderkey % 3 = 0"), ("b", "l_orderkey % 3 = 1"), ("b", "l_orderkey % 3 = 1"), ("c", "l_orderkey % 3 = 2")):
        daily.add_history(table, points.where(part), name)
    return table


@_query(_ANALYZED)
def daily_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The same analysis from figures that are kept by day."""
    buy = metrics.buyable_price(F.col("amazon_price"), F.col("new_price"))
    out = daily.analyze_daily(_daily(spark, sf).read(spark), testdata.prices(spark, sf), buy, F.lit("2000-08-01").cast("timestamp"), as_of())
    return out.select("product_id", "country", "points", "low", "high", F.round("average", 2).alias("average"), "recommendation")


_COVERAGE = (
    "select p.id, coalesce(days, 0) as days, coalesce(points, 0) as points from products p left join (select product_id, cast(greatest(1, ceil((epoch(max(recorded_at)) - epoch(min(recorded_at))) / 86400)) as bigint) as days, count(*) as points from history group by product_id) h on p.id = h.product_id"
)


@_query(_COVERAGE)
def history_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_coverage(testdata.history(spark, sf), testdata.products(spark, sf))


@_query(_COVERAGE)
def daily_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_coverage(_daily(spark, sf).read(spark), testdata.products(spark, sf))


@_query("select count(*) as n_rows, count(distinct product_id) as products, cast(min(recorded_at) as date) as oldest, cast(max(recorded_at) as date) as newest, cast(date_diff('day', cast(min(recorded_at) as date), cast(max(recorded_at) as date)) as bigint) as days from history")
def history_stats(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_stats(testdata.history(spark, sf))


_ORDER = "recorded_at, l_orderkey, l_linenumber, l_suppkey, price"


@_query(f"select product_id, country, price_type, price, old_price from (select *, lag(price) over (partition by product_id, country, price_type order by {_ORDER}) as old_price from history) x where price <> old_price")
def price_changes(spark: SparkSession, sf: str) -> DataFrame:
    out = history.price_changes_log(testdata.history(spark, sf), ["recorded_at", "l_orderkey", "l_linenumber", "l_suppkey", "price"])
    return out.select("product_id", "country", "price_type", "price", "old_price")


@_query(
    """select product_id, country, price_type, price, round(avg(price) over (w range between interval 30 days preceding and current row), 4) as avg30,
round(avg(price) over (w range between interval 90 days preceding and current row), 4) as avg90,
min(price) over (w range between unbounded preceding and current row) as low, max(price) over (w range between unbounded preceding and current row) as high
from history window w as (partition by product_id, country, price_type order by recorded_at)"""
)
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = history.rolling_price_stats(testdata.history(spark, sf))
    return out.select("product_id", "country", "price_type", "price", F.round("avg30", 4).alias("avg30"), F.round("avg90", 4).alias("avg90"), "low", "high")


@_query(
    """select product_id, country, round(case when hi > lo then (price - lo) / (hi - lo) else 0 end, 6) as y from (
select *, min(price) over (partition by product_id, country) lo, max(price) over (partition by product_id, country) hi, count(*) over (partition by product_id, country) n from history) x where n >= 2"""
)
def chart_series(spark: SparkSession, sf: str) -> DataFrame:
    out = history.chart_series(testdata.history(spark, sf), ["product_id", "country"])
    return out.select("product_id", "country", F.round("y", 6).alias("y"))


@_query(
    f"""select id, other_id, place from (select a.id, b.id as other_id, row_number() over (partition by a.id order by abs(b.price - a.price), b.id) as place
from (select id, category, {_PRICE} as price from products join prices on id = product_id where country = 'de') a
join (select id, category, {_PRICE} as price from products join prices on id = product_id where country = 'de') b on a.category = b.category and a.id <> b.id) x where place <= 4"""
)
def similar_products(spark: SparkSession, sf: str) -> DataFrame:
    return listing.similar_products(_priced(spark, sf)).select("id", "other_id", "place")


@_query("select asin, case when r is null then 'insert' when l is null then 'untouched' else 'update' end as status from (select coalesce(a.asin, b.asin) as asin, a.asin as l, b.asin as r from (select asin from products where id % 10 < 7) a full join (select asin from products where id % 10 > 3) b on a.asin = b.asin) x")
def catalog_diff(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf)
    return catalog.catalog_diff(p.where("id % 10 < 7"), p.where("id % 10 > 3"))


@_query(
    """select status, count(*) as n from (select case when a.asin is null then 'no_local_product' when b.asin is null then 'no_remote_product' else 'ok' end as status
from prices left join (select * from products where id % 10 < 7) a on product_id = a.id left join (select * from products where id % 10 > 3) b on a.asin = b.asin) x group by status"""
)
def remap_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf)
    out = catalog.remap_ids(testdata.prices(spark, sf), p.where("id % 10 < 7"), p.where("id % 10 > 3").withColumn("id", F.col("id") + 1_000_000))
    return out.groupBy("status").agg(F.count("*").alias("n"))


@_query("select id from products p left join (select * from prices where country = 'de') x on p.id = x.product_id where last_updated is null or last_updated < cast('2001-05-01' as timestamp)")
def stale_prices(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.stale_prices(testdata.products(spark, sf), testdata.prices(spark, sf), "de", F.lit("2001-05-01").cast("timestamp")).select("id")


@_query(
    """select coalesce(t.id, u.id) as id, case when u.id is not null then u.brand else t.brand end as brand, case when t.id is null then u.list_price else t.list_price end as list_price
from (select id, brand, list_price from products where id % 3 <> 0) t full join (select id, brand || '*' as brand, list_price + 1 as list_price from products where id % 2 = 0) u on t.id = u.id"""
)
def upserted_products(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).select("id", "brand", "list_price")
    new = p.where("id % 2 = 0").select("id", F.concat("brand", F.lit("*")).alias("brand"), (F.col("list_price") + 1).alias("list_price"))
    return upsert(p.where("id % 3 <> 0"), new, ["id"], ["brand"])


@_query("select distinct field, value from (select 'brand' as field, brand as value from products union all select 'category', category from products union all select 'capacity_unit', capacity_unit from products) x")
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return listing.facet_values(testdata.products(spark, sf), ["brand", "category", "capacity_unit"])


@_query(
    f"""select parent, category, count(*) as n from (select category, {_PRICE} as price from products join prices on id = product_id where country = 'de') x
join (values ('hard-drives', 'elektroartikel'), ('ssds', 'elektroartikel'), ('ram', 'pc-komponenten'), ('cpu', 'pc-komponenten'), ('tvs', 'elektroartikel'), ('monitors', 'elektroartikel')) c(slug, parent) on slug = category
where price > 0 group by rollup(parent, category)"""
)
def hub_counts(spark: SparkSession, sf: str) -> DataFrame:
    return listing.hub_counts(_priced(spark, sf), dims.categories(spark), rollup=True)


@_query(
    f"""select id, badge from (select id, case when u = min(u) over (partition by category) then 'Best Price' when u < 0.85 * avg(u) over (partition by category) then 'Good Deal' end as badge
from (select id, category, {_UNIT_PRICE} as u from (select *, {_PRICE} as price from products join prices on id = product_id where country = 'de') x join {_UNITS} on slug = category where price > 0) y) z where badge is not null"""
)
def unit_badges(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing.localized_listing(testdata.products(spark, sf), testdata.prices(spark, sf), dims.categories(spark), "de")
    return listing.unit_badges(rows, "category").where("badge is not null").select("id", "badge")


@_query(
    f"""select id, category, page from (select id, category, cast(floor((row_number() over (partition by category order by price, id) - 1) / 24) + 1 as int) as page
from (select id, category, {_PRICE} as price from products join prices on id = product_id where country = 'de') x where price > 0) y"""
)
def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _priced(spark, sf).where("price > 0")
    return listing.all_pages(rows, "category", [F.col("price").asc(), F.col("id").asc()], coarse=listing.price_band(F.col("price"))).select("id", "category", "page")


@_query(
    f"""select id, price from (select id, title, category, capacity_unit, {_PRICE} as price from products join prices on id = product_id where country = 'de') x
where category in ('ssds', 'ram') and price > 0 and price <= 1500 and lower(title) like '%a%' order by price, id limit 24 offset 24"""
)
def category_page(spark: SparkSession, sf: str) -> DataFrame:
    params = listing.FilterParams(search="a", values={"category": ["ssds", "ram"]}, max_price=1500)
    return listing.paginate(listing.sort_listing(listing.facet_filter(_priced(spark, sf), params), "price"), 2).select("id", "price")


@_query(
    """select id, place from (select *, row_number() over (partition by category order by list_price * monthly_sold desc, id) as place from (
select *, row_number() over (partition by category, coalesce(parent_asin, asin) order by list_price * monthly_sold desc, id) as a from products) x where a = 1) y where place <= 10"""
)
def picks_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    rows = testdata.products(spark, sf).withColumn("score", F.col("list_price") * F.col("monthly_sold"))
    return curation.by_parent(rows, curation.Options(per_category=10)).select("id", "place")


@_query()
def home_sections(spark: SparkSession, sf: str) -> DataFrame:
    return curation.home_sections(testdata.products(spark, sf), testdata.prices(spark, sf), "de", "age_days")


@_query(
    """select id, case when nz.best is null then null else nz.best end as best_price, n as n_offers from (
select id, min(price) as best, count(*) as n from (select id, list_price as price from products union all select id, list_price * 0.9 from products where id % 2 = 0 union all select id, list_price * 1.1 from products where id % 3 = 0) x group by id) nz"""
)
def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).select("id", "title", "brand", "list_price")
    src = lambda df, name, f, day: df.select("id", "title", "brand", (F.col("list_price") * f).alias("price"), F.lit(name).alias("source"), F.lit(day).cast("date").alias("last_updated"))
    parts = [src(p, "paapi", F.lit(1.0), "2001-07-01"), src(p.where("id % 2 = 0"), "static", F.lit(0.9), "2001-07-20"), src(p.where("id % 3 = 0"), "feed", F.lit(1.1), "2001-06-01")]
    out = merge.merge_sources(parts, ["title", "brand"])
    return out.select("id", "best_price", F.size("offers").cast("long").alias("n_offers"))


@_query(
    """select product_id, s_name as merchant, price, place from (select *, row_number() over (partition by product_id order by price, s_name) as place from (
select l_partkey as product_id, s_name, min(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100) as price from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey, s_name) x) y where place <= 3""",
    derived=False,
)
def ranked_offers(spark: SparkSession, sf: str) -> DataFrame:
    li, su = testdata.table(spark, sf, "lineitem"), testdata.table(spark, sf, "supplier")
    offers = li.join(su, li["l_suppkey"] == su["s_suppkey"]).groupBy(F.col("l_partkey").alias("product_id"), F.col("s_name").alias("merchant_name")).agg(F.min(half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)).alias("price"))
    ranked = listing.rank_offers(offers.withColumn("shipping_cost", F.lit(0.0))).where("place <= 3")
    return ranked.select("product_id", F.col("merchant_name").alias("merchant"), "price", "place")


@_query("""select doc_id, cast(ceil(len(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\x0B\\f\\r]+')) / 200) as bigint) || ' min read' as reading from documents where text is not null""", derived=False)
def reading_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return testdata.table(spark, sf, "documents").where("text is not null").select("doc_id", normalize.reading_time(F.col("text")).alias("reading"))


_TOKENS = "list_filter(string_split_regex(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


_SEARCH = (
    f""", tok as (select id as doc, {_TOKENS.format("title || ' ' || brand")} as t from products),
idx as (select token, doc, length, count(*) as tf from (select doc, len(t) as length, unnest(t) as token from tok) x group by all),
n as (select count(*) as docs, avg(length) as mean from (select distinct doc, length from idx) x),
terms as (select distinct query_id, term from (select id as query_id, unnest({_TOKENS.format("brand || ' ' || substring(string_split(title, ' ')[2], 1, 3)")}) as term from products where id % 50 = 0) x where length(term) >= 2),
found as (select query_id, term, doc, length, sum(tf) as tf from terms join idx on starts_with(token, term) group by all),
df as (select query_id, term, count(*) as df from found group by all),
wanted as (select query_id, count(*) as n_terms from terms group by all),
scored as (select query_id, doc, count(*) as c, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as s from found join df using (query_id, term) cross join n group by query_id, doc)
select query_id, doc, round(s, 6) as score, place from (select query_id, doc, s, row_number() over (partition by query_id order by round(s, 9) desc, doc) as place from scored join wanted using (query_id) where c = n_terms) x where place <= 10"""
)


@_query(_SEARCH)
def product_search(spark: SparkSession, sf: str) -> DataFrame:
    index = search.build_index(testdata.products(spark, sf), ["title", "brand"])
    words = testdata.products(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lower("brand"), F.substring(F.get(F.split("title", " "), F.lit(1)), 1, 3)).alias("query"))
    return search.search(index, words).select("query_id", "doc", F.round("score", 6).alias("score"), "place")


@_query(_SEARCH)
def stored_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same from an index in files: written with other texts for some products and with some that there are not, then updated."""
    p = testdata.products(spark, sf)
    odd = F.col("id") % 10 == 0
    before = p.select(F.when(odd, F.concat(F.lit("old words "), "brand")).otherwise(F.col("title")).alias("title"), "brand", F.when(F.col("id") % 40 == 1, -F.col("id")).otherwise(F.col("id")).alias("id"))
    index = search.StoredIndex(scratch(spark, "index"), 32, 2)
    index.update(before, ["title", "brand"])
    index.update(p.where(odd | (F.col("id") % 40 == 1)), ["title", "brand"], removed=p.where("id % 40 = 1").select((-F.col("id")).alias("id")))
    words = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lower("brand"), F.substring(F.get(F.split("title", " "), F.lit(1)), 1, 3)).alias("query"))
    return index.search(words).select("query_id", "doc", F.round("score", 6).alias("score"), "place")


@_query("select id, title from products where lower(title) like '%red%' or lower(title) like '%brass%' order by id limit 50")
def title_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_like(testdata.products(spark, sf), ["red", "brass"], 50).select("id", "title")


@_query()
def product_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.with_slugs(testdata.products(spark, sf)).select("id", "slug")


@_query("select id, asin as new_asin from products")
def legacy_redirects(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).withColumn("slug", F.concat(F.lit("p-"), F.col("id").cast("string")))
    old = p.select(F.concat("slug", F.lit("-"), F.lower("asin")).alias("slug"))
    out = catalog.redirect_map(old, p, normalize.asin_from_slug(F.col("slug")))
    return out.select(F.substring("new_slug", 3, 20).cast("long").alias("id"), F.col("asin").alias("new_asin"))


@_query(
    f"""select id, case when price_avg_90 > price and floor((price_avg_90 - price) / price_avg_90 * 100 + 0.5) <= 80 then floor((price_avg_90 - price) / price_avg_90 * 100 + 0.5) else 0e0 end as discount
from (select id, price_avg_90, {_PRICE} as price from products join prices on id = product_id where country = 'de') x"""
)
def discounts(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).select("id", F.coalesce(metrics.discount_rate(F.col("price"), F.col("price_avg_90")), F.lit(0.0)).alias("discount"))


@_query(
    f"""select id, country, coalesce(case when country in ('de', 'es', 'it', 'fr') then translate(format('{{:,.2f}}', price), ',.', '.,') || ' €' else case country when 'uk' then '£' else '$' end || format('{{:,.2f}}', price) end, '–') as text
from (select id, country, {_PRICE} as price from products join prices on id = product_id) x"""
)
def formatted_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Prices in the manner of their country."""
    return _priced(spark, sf, None).select("id", "country", formatting.format_price(F.col("price"), F.col("country")).alias("text"))


@_query(
    f"""select count(*) as n, count(*) filter (where {_PRICE} is not null) as with_offer from products p left join prices on p.id = product_id and country = 'de'"""
)
def structured_data(spark: SparkSession, sf: str) -> DataFrame:
    price = metrics.effective_price(F.col("amazon_price"), F.col("new_price"), F.col("used_price"))
    p = testdata.products(spark, sf)
    built = catalog.build_products(p, testdata.prices(spark, sf).where("country = 'de'"), price)
    doc = export.product_jsonld(p.join(listing.price_range(built), "id"))
    return doc.agg(F.count("*").alias("n"), F.count(F.when(F.col("jsonld").contains("AggregateOffer"), 1)).alias("with_offer"))


_DUE = """select m.product_id, m.country, t, p, used_price from (select product_id, country, case when amazon_price is not null then 'amazon' else 'new' end as t, coalesce(amazon_price, new_price) as p, used_price from prices) m
left join (select product_id, country, price_type, max(recorded_at) as last from history where recorded_at <= cast('2001-08-01' as timestamp) group by product_id, country, price_type) l
on m.product_id = l.product_id and m.country = l.country and m.t = l.price_type where p > 0 and (last is null or last < cast('2001-07-31 01:00:00' as timestamp))"""


@_query(f"select product_id, country, t as price_type, p as price from ({_DUE}) d union all select product_id, country, 'used', used_price from ({_DUE}) d where used_price > 0")
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    out = history.snapshot_history(testdata.prices(spark, sf), testdata.history(spark, sf), as_of(), 23)
    return out.select("product_id", "country", "price_type", "price")


@_query("select user_id as product_id, date_trunc('day', ts) as day, round(min(value), 6) as low, round(max(value), 6) as high from events group by 1, 2", derived=False)
def daily_price_range(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the stream's daily windows."""
    t = streaming.as_ticks(testdata.table(spark, sf, "events"))
    out = streaming.daily_range(t)
    return out.select("product_id", F.col("day").cast("timestamp_ntz").alias("day"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@_query("select user_id as product_id, max_by(value, (ts, event_id)) as price from events group by user_id", derived=False)
def latest_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.latest(streaming.as_ticks(testdata.table(spark, sf, "events"))).select("product_id", "price")


@_query("select product_id, country, nullif(coalesce(amazon_price, new_price), 0) as price, case when amazon_price is not null then 'amazon' else 'new' end as price_type from prices where nullif(coalesce(amazon_price, new_price), 0) is not null")
def buyable_prices(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.prices(spark, sf).withColumn("price", metrics.buyable_price(F.col("amazon_price"), F.col("new_price"))).where("price is not null")
    return p.select("product_id", "country", "price", metrics.buyable_type(F.col("amazon_price")).alias("price_type"))


@_query("select p.id, least(coalesce(n, 0), 100) as points from products p left join (select product_id, count(*) as n from history where recorded_at >= cast('2000-01-01' as timestamp) group by product_id) h on p.id = product_id")
def product_details(spark: SparkSession, sf: str) -> DataFrame:
    out = catalog.product_detail(testdata.products(spark, sf), testdata.history(spark, sf), F.lit("2000-01-01").cast("timestamp"))
    return out.select("id", F.coalesce(F.greatest(F.size("price_history"), F.lit(0)), F.lit(0)).cast("long").alias("points"))


@_query("select asin, id % 4 <> 0 as is_new from products")
def new_and_known(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf)
    return catalog.split_new_existing(p.select("asin"), p.where("id % 4 = 0")).select("asin", "is_new")


@_query(f"select id, brand from products where lower(brand) = 'brand#2' or brand in (select max(brand) from products) or ({_NEW})")
def brand_and_new(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf)
    top = p.agg(F.max("brand")).first()[0]
    found = listing.by_brand(p, top).select("id", "brand").union(listing.by_brand(p, "BRAND#2").select("id", "brand")).union(listing.only_new(p).select("id", "brand"))
    return found.distinct()


_LISTED = f"(select id, brand, category, price, {_UNIT_PRICE} as unit_price from (select *, {_PRICE} as price from products join prices on id = product_id where country = 'de') x join {_UNITS} on slug = category where price > 0) y"


@_query(f"select id from {_LISTED} order by unit_price is null, coalesce(unit_price, price), id limit 40")
def hub_deals(spark: SparkSession, sf: str) -> DataFrame:
    return listing.hub_deals(listing.localized_listing(testdata.products(spark, sf), testdata.prices(spark, sf), dims.categories(spark), "de"), 40).select("id")


@_query(f"select id from {_LISTED} where category = 'ssds' and unit_price is not null order by unit_price, id limit 3")
def quick_picks(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing.localized_listing(testdata.products(spark, sf), testdata.prices(spark, sf), dims.categories(spark), "de", "ssds")
    return listing.quick_picks(rows).select("id")


@_query(
    f"""select id, category, place from (select id, category, row_number() over (partition by category order by n desc, lower(brand), brand, id) as place
from products join (select product_id, count({_PRICE}) as n from prices group by product_id) c on id = product_id where n > 0) x where place <= 10"""
)
def hub_bestsellers(spark: SparkSession, sf: str) -> DataFrame:
    price = metrics.effective_price(F.col("amazon_price"), F.col("new_price"), F.col("used_price"))
    built = catalog.build_products(testdata.products(spark, sf), testdata.prices(spark, sf), price).withColumn("n_countries", F.size("prices_by_country")).where("n_countries > 0")
    return listing.hub_bestsellers(built, 10, "category").select("id", "category", "place")


@_query("select id, case when id % 2 = 0 then 'static' else 'paapi' end as source from products")
def first_available(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).select("id", "title")
    src = lambda df, name: df.withColumn("source", F.lit(name))
    return merge.first_available([src(p.where("id % 2 = 0"), "static"), src(p, "paapi")]).select("id", "source")


@_query(
    f"""select asin from (select asin, case when sales_rank <= 5000 then 0 else 1 end as l, case when sales_rank <= 5000 then sales_rank else id end as place
from products left join (select product_id from prices where country = 'de' and price_avg_90 > {_PRICE}) d on id = d.product_id where sales_rank <= 5000 or d.product_id is not null) x order by l, place, asin limit 200"""
)
def discovery_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf)
    best = p.where("sales_rank <= 5000").select("asin", F.col("sales_rank").cast("long").alias("place"))
    return ingest.discovery_candidates(best, _priced(spark, sf).where("price_avg_90 > price").select("asin", F.col("id").alias("place")), 200)


@_query("select id, trim(string_split_regex(title, ' - | \\(| \\||, ')[1]) as title, case when title like '%Renewed%' then 'Used' else 'New' end as condition, cast(regexp_extract(title, '([0-9]+)\\s?(GB|TB)', 1) as double) as capacity from products")
def display_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    got = normalize.extract_capacity(t, F.lit("TB"))["capacity"]
    return testdata.products(spark, sf).select("id", normalize.display_title(t, F.lit(None).cast("string")).alias("title"), normalize.condition_of(t, F.col("condition")).alias("condition"), got.alias("capacity"))


@_query(
    """select 'https://x/p/' || asin as url, 0.8 as priority from products union all select 'https://x/c/' || category, 0.9 from (select distinct category from products) c"""
)
def sitemap(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).withColumn("slug", F.col("asin")).withColumn("updated_at", as_of())
    tree = p.select(F.col("category").alias("slug")).distinct().withColumn("hidden", F.lit(False))
    return export.sitemap("https://x", p, tree, None, ["de", "en"]).select("url", F.col("priority").cast("decimal(2,1)").alias("priority"))


@_query(
    """select p.product_id, p.country, x.list_price as price from prices p join products x on x.id = p.product_id
where p.country = 'de' and p.last_updated < cast('2001-07-31 13:00:00' as timestamp) and coalesce(p.amazon_price, p.new_price) is distinct from x.list_price and x.list_price > 0"""
)
def price_update_changes(spark: SparkSession, sf: str) -> DataFrame:
    """History rows of an update run whose feed sells everything at list price."""
    p, prices = testdata.products(spark, sf), testdata.prices(spark, sf)
    none = F.lit(None).cast("double")
    feed = p.select("asin", F.col("list_price").alias("amazon_price"), none.alias("new_price"), none.alias("used_price"))
    _, _, added = ingest.update_prices(p, prices, feed, "de", as_of())
    return added.select("product_id", "country", "price")


@_query("select category, count(*) as n from products where id % 4 <> 0 group by category")
def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf)
    return ingest.import_summary(p, p.where("id % 4 = 0"))


@_query("select id, case when id % 3 = 0 then 'Shop' else 'Amazon' end as merchant from products")
def offers_or_default(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).withColumn("price", F.col("list_price"))
    offers = p.where("id % 3 = 0").select(F.col("id").alias("product_id"), F.lit("Shop").alias("merchant_name"), "price", F.lit(1.0).alias("shipping_cost"))
    return catalog.offers_or_default(p, offers).select("id", F.get("offers", F.lit(0))["merchant_name"].alias("merchant"))


@_query("select count(*) as n, min(ts) as first from (select distinct event_id, ts from events) x", derived=False)
def distinct_ticks(spark: SparkSession, sf: str) -> DataFrame:
    t = streaming.dedupe_ticks(streaming.as_ticks(testdata.table(spark, sf, "events")))
    return t.agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first"))


@_query(
    """select product_id, until, round(avg(price), 6) as average from (select user_id as product_id, value as price, unnest(generate_series(date_trunc('day', ts) + interval 1 day, date_trunc('day', ts) + interval 7 day, interval 1 day)) as until from events) x group by 1, 2""",
    derived=False,
)
def weekly_averages(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the stream's sliding windows, seven days long."""
    t = streaming.as_ticks(testdata.table(spark, sf, "events"))
    return streaming.sliding_average(t, 7).select("product_id", F.col("until").cast("timestamp_ntz").alias("until"), F.round("average", 6).alias("average"))


@_query("select 'products' as name, count(*) as n from products union all select 'prices', count(*) from prices union all select 'history', count(*) from history")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return listing.counts({"products": testdata.products(spark, sf), "prices": testdata.prices(spark, sf), "history": testdata.history(spark, sf)})


@_query(f"select id, price from {_LISTED} order by price desc, id limit 30")
def dearest_lite(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing.localized_listing(testdata.products(spark, sf), testdata.prices(spark, sf), dims.categories(spark), "de")
    return listing.lite(listing.sort_listing(rows, "price", True).limit(30), ["id", "price"])


@_query("select id from products where id % 2 = 0 order by sales_rank nulls first, id limit 500")
def enrichment_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.enrichment_candidates(testdata.products(spark, sf).withColumn("history_seeded", F.when(F.col("id") % 2 == 1, True))).select("id")


@_query("select id, case when id % 2 = 0 then list_price else null end as price_avg_90, coalesce(id % 2 = 0, false) as seeded from products")
def enriched_products(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).select("id", "asin", "sales_rank", "list_price").withColumn("price_avg_90", F.lit(None).cast("double")).withColumn("history_seeded", F.lit(None).cast("boolean"))
    feed = p.where("id % 2 = 0").select("asin", F.col("list_price").alias("price_avg_90"), "sales_rank")
    out = ingest.enrich(p, feed, 10_000_000)
    return out.select("id", "price_avg_90", F.coalesce("history_seeded", F.lit(False)).alias("seeded"))


@_query("select product_id, country, coalesce(nullif(amazon_price, 0), nullif(new_price, 0), nullif(price_avg_90, 0)) as price from prices")
def sync_prices(spark: SparkSession, sf: str) -> DataFrame:
    price = metrics.sync_price(F.col("amazon_price"), F.col("new_price"), F.col("price_avg_90"))
    return testdata.prices(spark, sf).select("product_id", "country", price.alias("price"))


@_query(
    """select id, case id % 5 when 0 then 'new' when 1 then 'new' when 2 then 'refurbished' when 3 then 'used' else 'used' end as ebay,
case id % 5 when 0 then 'new' when 1 then 'used' when 2 then 'renewed' when 3 then 'renewed' else 'new' end as paapi,
case id % 5 when 0 then 'in_stock' when 1 then 'out_of_stock' when 2 then 'preorder' else 'unknown' end as availability, capacity, upper(capacity_unit) as capacity_unit from products"""
)
def mapped_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of other markets, and sizes like 2TB."""
    nth = lambda *codes: F.element_at(F.array(*map(F.lit, codes)), (F.col("id") % 5 + 1).cast("int"))
    size = normalize.split_capacity(F.concat(F.col("capacity").cast("int").cast("string"), F.lit(" "), F.lower("capacity_unit")))
    return testdata.products(spark, sf).select(
        "id", normalize.map_ebay_condition(nth("1000", "1500", "2010", "3000", None)).alias("ebay"), normalize.map_paapi_condition(nth("New", "used", "Refurbished", "renewed", "?")).alias("paapi"),
        normalize.map_availability(nth("Now", "OutOfStock", "PreOrder", "x", None)).alias("availability"), size["capacity"].alias("capacity"), size["capacity_unit"].alias("capacity_unit"),
    )


@_query(
    """select id, 'https://www.amazon.' || case when id % 2 = 0 then 'de' else 'co.uk' end || '/dp/' || asin || '?tag=t-' || id % 3 as link,
'https://rover.ebay.com/rover/1/c1/1?mpre=https%3A%2F%2Fx%2F' || asin as tracked, '/out/' || asin as redirect, 'https://media-amazon.com/' || asin || '._AC_SX250_.jpg' as tagged,
'https://media-amazon.com/' || asin || '._SX80_.jpg' as injected from products"""
)
def product_links(spark: SparkSession, sf: str) -> DataFrame:
    asin, image = F.col("asin"), F.concat(F.lit("https://media-amazon.com/"), F.col("asin"), F.lit("._AC_SY400_.jpg"))
    country = F.when(F.col("id") % 2 == 0, "de").otherwise("uk")
    return testdata.products(spark, sf).select(
        "id", formatting.affiliate_url(asin, country, F.concat(F.lit("t-"), (F.col("id") % 3).cast("string"))).alias("link"),
        formatting.tracked_url(F.concat(F.lit("https://x/"), asin), "c1").alias("tracked"), formatting.redirect_path(asin).alias("redirect"),
        normalize.image_url(image).alias("tagged"), normalize.image_url(image, 80, "inject").alias("injected"),
    )


@_query(
    """select id, place, label, value from (select id, 0 as place, 'Brand' as label, brand as value from products union all select id, 1, 'Size', cast(capacity as varchar) from products
union all select id, 2, 'Kategorie', category from products union all select id, 3, 'unit', capacity_unit from products where id % 2 = 0) x where value <> ''"""
)
def spec_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Core columns, then the spec map: one translated label, one empty value, one label twice."""
    unit = F.when(F.col("id") % 2 == 0, F.col("capacity_unit")).otherwise(F.lit(" "))
    specs = F.create_map(F.lit("category"), F.col("category"), F.lit("unit"), unit, F.lit("brand"), F.lit("again"))
    labels = testdata.products(spark, sf).select(F.lit("category").alias("key"), F.lit("Kategorie").alias("label")).distinct()
    rows = export.spec_table(testdata.products(spark, sf).withColumn("specs", specs), {"brand": "Brand", "capacity": "Size"}, labels)
    return rows.select("id", F.col("place").cast("int").alias("place"), "label", "value")


@_query(
    """select id from products where cast('2001-08-01' as timestamp) - age_days * interval 1 hour < cast('2001-08-01' as timestamp)
 - interval 1 hour * (select case when count(*) < 1000 then 1 when count(*) < 5000 then 6 when count(*) < 15000 then 12 else 24 end from products) order by age_days desc, id limit 100"""
)
def stale_products(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).withColumn("updated_at", as_of() - F.make_dt_interval(hours=F.col("age_days").cast("int")))
    return ingest.stale_products(p, as_of(), 100).select("id")


@_query("select id, 2 as n_filters from products where category = 'ssds' and rating >= 4")
def keyed_filters(spark: SparkSession, sf: str) -> DataFrame:
    filters = {"category": "ssds", "rating": 4.0, "brand": "", "unit": None}
    test = lambda name, v: F.col(name) >= v if name == "rating" else F.col(name) == v
    return listing.apply_filters(testdata.products(spark, sf), filters, test).select("id", F.lit(listing.active_filters(filters)).alias("n_filters"))


@_query(
    """select asin, coalesce(case when id % 3 = 0 then id when id % 3 = 1 then id + 1000000 end, case when id % 4 = 0 then g end) as product_id from (select *, min(id) over (partition by brand) as g from products) x"""
)
def resolved_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """By the country's identifier (a third), one without country (a third), else by gtin (a quarter)."""
    p = testdata.products(spark, sf)
    own = p.where("id % 3 = 0").select(F.lit("s").alias("source"), F.col("asin").alias("external_id"), F.lit("de").alias("country"), F.col("id").alias("product_id"))
    any_ = p.where("id % 3 <> 2").select(F.lit("s").alias("source"), F.col("asin").alias("external_id"), F.lit(None).cast("string").alias("country"), (F.col("id") + 1_000_000).alias("product_id"))
    feed = p.select(F.lit("s").alias("source"), F.col("asin").alias("external_id"), F.lit("de").alias("country"), F.when(F.col("id") % 4 == 0, F.col("brand")).alias("gtin"))
    out = catalog.resolve_identifiers(feed, own.union(any_), p.withColumn("gtin", F.col("brand")))
    return out.select(F.col("external_id").alias("asin"), "product_id")


@_query(
    """select id, case when category in ('ram', 'cpu') then 'elektroartikel/computer/pc-komponenten/' || category else 'elektroartikel/' || category end as path, category in ('ssds', 'hard-drives', 'tvs', 'monitors') as top from products"""
)
def product_paths(spark: SparkSession, sf: str) -> DataFrame:
    tree = dims.categories(spark)
    top = catalog.category_children(tree, "elektroartikel").select("slug", F.lit(True).alias("top"))
    paths = catalog.category_paths(tree).select(F.col("slug").alias("category"), F.array_join("path", "/").alias("path")).join(top, F.col("slug") == F.col("category"), "left")
    return testdata.products(spark, sf).join(F.broadcast(paths), "category").select("id", "path", F.coalesce("top", F.lit(False)).alias("top"))


@_query(
    f"""select product_id, country, case when d <= -15 then 'great_deal' when d <= -5 then 'good_price' when d <= 5 then 'fair' else 'wait' end as recommendation
from (select product_id, country, coalesce((p - coalesce(a, p)) / nullif(coalesce(a, p), 0) * 100, 0) as d from (select product_id, country, {_PRICE} as p, price_avg_90 as a from prices) x) y"""
)
def feed_analysis(spark: SparkSession, sf: str) -> DataFrame:
    price = metrics.effective_price(F.col("amazon_price"), F.col("new_price"), F.col("used_price"))
    out = history.analyze_feed(testdata.prices(spark, sf).withColumn("current", price).withColumn("avg90", F.col("price_avg_90")))
    return out.select("product_id", "country", "recommendation")


@_query(
    f"""select count(*) as total, min(last_updated) as oldest, count(*) filter (where category = 'ram') as filtered, cast(ceil(count(*) filter (where category = 'ram') / 24) as bigint) as pages
from (select *, {_PRICE} as price from products join prices on id = product_id where country = 'de') x where price > 0"""
)
def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The composed category page: its summary."""
    rows = listing.localized_listing(testdata.products(spark, sf), testdata.prices(spark, sf), dims.categories(spark), "de")
    _, summary = listing.category_page(rows, listing.FilterParams(values={"category": ["ram"]}), "price", 1)
    return summary.withColumn("oldest", F.col("oldest").cast("timestamp_ntz"))


@_query("select case when id % 3 = 0 then 'skipped' when id % 4 = 0 then 'updated' else 'added' end as status, count(*) as n from products group by 1")
def import_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf)
    return ingest.import_outcome(p.select(F.col("asin").alias("ASIN")), p.where("id % 3 <> 0"), p.where("id % 4 = 0"))


@_query(f"select id from products join prices on id = product_id where country = 'de' and {_PRICE} > 0 order by age_days desc, id limit 20")
def hub_new(spark: SparkSession, sf: str) -> DataFrame:
    return listing.hub_new(_priced(spark, sf), 20, "age_days").select("id")


@_query("select id from products order by age_days desc, id limit 100")
def recent_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return listing.recent_slugs(testdata.products(spark, sf), 100, "age_days").select("id")


@_query("select id, 'p' as by from (select id from products order by case when id % 4 = 0 then 1e300 else list_price end, id limit 50) x union all select id, 'r' from (select id from products order by rating desc, id limit 50) y")
def unified_order(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).withColumn("best_price", F.when(F.col("id") % 4 != 0, F.col("list_price")))
    first = lambda by, name: merge.sort_unified(p, by).limit(50).select("id", F.lit(name).alias("by"))
    return first("price", "p").union(first("rating", "r"))


@_query(
    """select coalesce(a.asin, b.asin) as asin, case when a.asin is not null then a.brand else b.brand || '*' end as brand, b.asin is null as fresh
from (select * from products where id % 10 < 7) a full join (select * from products where id % 10 > 3) b on a.asin = b.asin"""
)
def deployed_products(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf).select("id", "asin", "brand")
    remote = p.where("id % 10 > 3").withColumn("brand", F.concat("brand", F.lit("*")))
    after, children = ingest.deploy(p.where("id % 10 < 7"), remote, {"prices": testdata.prices(spark, sf)})
    known = remote.select("asin", F.lit(False).alias("fresh"))
    return after.join(known, "asin", "left").select("asin", "brand", F.coalesce("fresh", F.lit(True)).alias("fresh"))


@_query(
    """select 'B' || lpad(cast(product_id as varchar), 9, '0') as asin, price_type, cast(recorded_at as timestamp) as recorded_at, price from history where price_type <> 'used'"""
)
def feed_points(spark: SparkSession, sf: str) -> DataFrame:
    """Flat (minute, cents) lists, made from the history, as rows again."""
    minutes = ((F.unix_seconds(F.col("recorded_at").cast("timestamp")) - normalize.FEED_EPOCH) / 60).cast("long")
    pair = F.array(minutes, F.round(F.col("price") * 100).cast("long"))
    point = lambda t: F.flatten(F.collect_list(F.when(F.col("price_type") == t, pair)))
    asin = F.concat(F.lit("B"), F.lpad(F.col("product_id").cast("string"), 9, "0")).alias("asin")
    feed = testdata.history(spark, sf).groupBy(asin).agg(F.array(point("amazon"), point("new")).alias("csv"))
    return history.explode_history(feed, {0: "amazon", 1: "new"}).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))


@_query(
    """select asin, condition, merchant, price, condition = 'new' as best from (select asin, 'new' as condition, 'Amazon' as merchant, amazon_price as price from products join prices on id = product_id where country = 'de'
union all select asin, 'used', 'Amazon Marketplace', used_price from products join prices on id = product_id where country = 'de') x where price > 0"""
)
def feed_offers(spark: SparkSession, sf: str) -> DataFrame:
    feed = catalog.join_prices(testdata.products(spark, sf), testdata.prices(spark, sf), "de").withColumn("warehouse_price", F.lit(0.0))
    offers = merge.feed_offers(feed)
    best = merge.best_offer(offers).select("asin", "merchant", F.lit(True).alias("best"))
    return offers.join(best, ["asin", "merchant"], "left").select("asin", "condition", "merchant", "price", F.coalesce("best", F.lit(False)).alias("best"))


@_query(
    """select 'ebay-' || id as id, 'ebay' as source, 'refurbished' as condition, list_price as price from products union all select asin, 'amazon-paapi', 'renewed', list_price from products
union all select asin, 'static', null, list_price from products"""
)
def unified_products(spark: SparkSession, sf: str) -> DataFrame:
    """One product as three sources show it."""
    p, none = testdata.products(spark, sf), F.lit(None).cast("string")
    base = p.withColumns({"item_id": F.col("id").cast("string"), "url": none, "image_url": none, "image": none, "shipping_cost": F.lit(0.0), "price": F.col("list_price")})
    ebay = merge.ebay_products(base.withColumn("condition_id", F.lit("2000"))).select("id", "source", "condition", "price")
    paapi = merge.paapi_products(base.withColumn("condition", F.lit("Refurbished")).withColumn("availability", F.lit("Now"))).select("id", "source", "condition", "price")
    static = merge.static_products(base.withColumn("prices", F.struct(F.col("list_price").alias("de"))), "de").select("id", "source", none.alias("condition"), "price")
    return ebay.union(paapi).union(static)


@_query(
    """select id, sales_rank > 0 and sales_rank < 10000 as bestseller, case when id % 10 > 0 and id % 10 / 10.0 > 0.05 then '-' || cast(id % 10 * 10 as varchar) || '%' end as saved,
cast(rating as decimal(3, 1)) as rating from products where sales_rank is not null"""
)
def card_badges(spark: SparkSession, sf: str) -> DataFrame:
    saved = formatting.savings_label((F.col("id") % 10).cast("double") / 10)
    p = testdata.products(spark, sf).where("sales_rank is not null")
    shown = F.replace(formatting.format_rating(F.col("rating")), F.lit(","), F.lit("."))
    return p.select("id", formatting.is_bestseller(F.col("sales_rank")).alias("bestseller"), saved.alias("saved"), shown.cast("decimal(3,1)").alias("rating"))


@_query(
    """select id, amazon, used, rank, stars, reviews, low from (select id, floor(list_price * 100) / 100e0 as amazon, null::double as used, sales_rank as rank, floor(rating * 10) / 10e0 as stars,
case when review_count > 0 then review_count end as reviews, floor(list_price * 90) / 100e0 as low from products) x"""
)
def decoded_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of the feed's list of numbers; lowest prices as [time, cents] text."""
    cents = F.floor(F.col("list_price") * 100)
    at = {0: cents, 2: F.lit(-1), 3: F.coalesce("sales_rank", F.lit(0)), 16: F.floor(F.col("rating") * 10), 17: F.col("review_count")}
    current = F.array(*[at.get(i, F.lit(-1)).cast("long") for i in range(18)])
    feed = testdata.products(spark, sf).select("id", F.struct(current.alias("current")).alias("stats"), F.concat(F.lit("[7,"), F.floor(F.col("list_price") * 90).cast("string"), F.lit("]")).alias("low"))
    out = normalize.decode_stats(feed)
    return out.select("id", F.col("amazon_price").alias("amazon"), F.col("used_price").alias("used"), F.col("sales_rank").alias("rank"), F.col("rating").alias("stars"), F.col("review_count").alias("reviews"), normalize.minmax_price(F.col("low")).alias("low"))


@_query(
    """select query_id, id, place from (select query_id, id, row_number() over (partition by query_id order by id) as place from (
  select distinct q.id as query_id, p.id from (select distinct id, unnest(list_filter(string_split_regex(lower(brand || ' ' || substring(string_split(title, ' ')[2], 2, 4) || case when id % 300 = 0 then ' x9' else '' end), '\\s+'), lambda w: w <> '')) as word from products where id % 100 = 0) q
  join products p on contains(lower(p.title), word)) h) x where place <= 50"""
)
def fallback_search(spark: SparkSession, sf: str) -> DataFrame:
    """One query for each product whose id is divisible by 100: its brand, a part of a word, sometimes two letters."""
    p = testdata.products(spark, sf)
    part = F.substring(F.get(F.split("title", " "), F.lit(1)), 2, 4)
    asked = F.concat(F.col("brand"), F.lit(" "), part, F.when(F.col("id") % 300 == 0, " x9").otherwise(""))
    return listing.fallback_search(p, p.where("id % 100 = 0").select(F.col("id").alias("query_id"), asked.alias("query")), 50)


@_query(
    """select p.id, case when id % 2 = 0 then id else sales_rank end as sales_rank, case when id % 2 = 0 and id % 3 > 0 then id % 3 / 10e0 else cast(rating as double) end as rating, case when id % 2 = 0 then 5 else review_count end as review_count from products p"""
)
def updated_metadata(spark: SparkSession, sf: str) -> DataFrame:
    p = testdata.products(spark, sf)
    ranks = F.create_map(F.lit("1"), F.array(F.array(F.lit(1), F.lit(9)), F.array(F.lit(2), F.col("id"))).cast("array<array<bigint>>"))
    feed = p.where("id % 2 = 0").select("asin", ranks.alias("salesRanks"), (F.col("id") % 3).alias("rating"), F.lit(5).alias("reviews"))
    return ingest.update_metadata(p, feed).select("id", "sales_rank", F.col("rating").cast("double").alias("rating"), "review_count")


_SYNCED = "select id, asin, list_price, id % 4 = 0 as fresh, case when id % 5 = 0 then null when id % 5 = 1 then list_price end as own from products where id % 2 = 0"


def _synced(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A feed of the products with even ids against a catalogue without those divisible by four."""
    from ..sources.readers import FEED_SCHEMA

    p, prices = testdata.products(spark, sf), testdata.prices(spark, sf)
    kind = FEED_SCHEMA.split("products array<", 1)[1].rsplit(">", 1)[0]
    cents = F.floor(F.col("list_price") * 100).cast("long")
    own = F.when(F.col("id") % 5 == 1, cents).otherwise(F.lit(-1).cast("long"))
    avg90 = F.when(F.col("id") % 5 == 0, F.lit(-1).cast("long")).otherwise(cents)
    body = F.to_json(F.struct(
        "asin", F.concat(F.lit("feed "), F.col("asin")).alias("title"), F.col("id").alias("lastUpdate"),
        F.struct(F.array(own, F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit(7).cast("long")).alias("current"), F.array(F.lit(-1).cast("long"), avg90).alias("avg90")).alias("stats"),
    ))
    feed = p.where("id % 2 = 0").select(F.from_json(body, kind).alias("p")).select("p.*")
    known = p.where("id % 4 <> 0").withColumn("slug", F.lower("asin"))
    return ingest.sync_feed(feed, known, prices.join(known.select(F.col("id").alias("product_id")), "product_id", "left_semi"), "de", as_of())


@_query(f"select asin, case when s is not null then 'feed ' || asin else title end as title, case when s is not null then 7 else sales_rank end as sales_rank from products left join (select asin as s from ({_SYNCED}) y) z on asin = s where id % 4 <> 0 or s is not null")
def synced_products(spark: SparkSession, sf: str) -> DataFrame:
    return _synced(spark, sf)[0].select("asin", "title", "sales_rank")


@_query(f"select count(*) as n, count(*) filter (where price_type = 'amazon') as own, round(sum(price), 2) as total from (select floor(list_price * 100) / 100e0 as price, case when own is null then 'new' else 'amazon' end as price_type from ({_SYNCED}) y where id % 5 <> 0) z")
def synced_history(spark: SparkSession, sf: str) -> DataFrame:
    return _synced(spark, sf)[2].agg(F.count("*").alias("n"), F.count(F.when(F.col("price_type") == "amazon", 1)).alias("own"), F.round(F.sum("price"), 2).alias("total"))
