"""Catalogue tables derived from the driver's tables. The statements run on Spark and,
for the checks, on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01"

#: Ticks: every line is a price seen at its supplier's region.
HISTORY = """
select l_partkey as product_id,
  case n_regionkey when 0 then 'us' when 1 then 'uk' when 2 then 'de' when 3 then 'fr' else 'es' end as country,
  floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 as price,
  case l_returnflag when 'A' then 'amazon' when 'N' then 'new' else 'used' end as price_type,
  l_shipdate as recorded_at, l_orderkey, l_linenumber, l_suppkey
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"""

_LATEST = """
select product_id, country, price_type, price, recorded_at from (
  select *, row_number() over (partition by product_id, country, price_type
    order by recorded_at desc, l_orderkey desc, l_linenumber desc, price desc, l_suppkey desc) as rn
  from history where recorded_at <= cast('2001-08-01' as timestamp)) x
where rn = 1"""

PRICES = f"""
select l.*, a.price_avg_30, a.price_avg_90 from (
  select product_id, country,
    max(case when price_type = 'amazon' then price end) as amazon_price, max(case when price_type = 'new' then price end) as new_price,
    max(case when price_type = 'used' then price end) as used_price, max(recorded_at) as last_updated
  from ({_LATEST}) y group by product_id, country) l
left join (
  select product_id, country,
    floor(avg(case when recorded_at > cast('2001-05-03' as timestamp) then price end) * 100 + 0.5) / 100 as price_avg_30,
    floor(avg(price) * 100 + 0.5) / 100 as price_avg_90
  from history where price_type in ('amazon', 'new') and recorded_at > cast('2000-08-01' as timestamp) and recorded_at <= cast('2001-08-01' as timestamp)
  group by product_id, country) a
on l.product_id = a.product_id and l.country = a.country"""

PRODUCTS = """
select p_partkey as id, 'B' || lpad(cast(p_partkey as string), 9, '0') as asin, p_brand as brand,
  p_brand || ' ' || p_name || ' ' || cast(p_size as string) || case when p_partkey % 2 = 0 then 'TB' else 'GB' end
    || case when p_partkey % 17 = 0 then ' (Renewed)' else '' end as title,
  case p_partkey % 6 when 0 then 'hard-drives' when 1 then 'ssds' when 2 then 'ram' when 3 then 'cpu' when 4 then 'tvs' else 'monitors' end as category,
  cast(p_size as double) as capacity, case when p_partkey % 2 = 0 then 'TB' else 'GB' end as capacity_unit, 'New' as condition,
  case when p_partkey % 7 = 0 then null else 1 + (p_partkey * 7919) % 30000 end as sales_rank,
  3 + (p_partkey % 21) / 10.0 as rating,
  coalesce(s.lines, 0) as review_count, coalesce(s.sold, 0) as monthly_sold,
  case when p_partkey % 5 = 0 then 'P' || cast(p_partkey % 500 as string) end as parent_asin, p_retailprice as list_price,
  p_partkey % 365 as age_days
from part left join (
  select l_partkey, count(*) as lines, cast(sum(l_quantity) as bigint) as sold from lineitem group by l_partkey) s on p_partkey = l_partkey"""

CTES = f"with history as ({HISTORY}), prices as ({PRICES}), products as ({PRODUCTS}) "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation")}
    return spark.sql(_placed(HISTORY, t), **t)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PRICES.replace("from history", "from {history}"), history=history(spark, sf_dir))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("part", "lineitem")}
    return spark.sql(_placed(PRODUCTS, t), **t)


def _placed(sql: str, tables: dict) -> str:
    for n in tables:
        sql = sql.replace(f"from {n} ", f"from {{{n}}} ").replace(f"join {n} ", f"join {{{n}}} ").replace(f"from {n}\n", f"from {{{n}}}\n")
    return sql
