"""Curated lists: gates, scores, and the greedy pick."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.semantics import filled
from .listing import best_deals_by_country, diverse_popular, new_arrivals, only_new


@dataclass(frozen=True)
class Options:
    items: int = 10
    per_category: int = 1
    min_price: float = 0.0
    needs_discount: bool = False
    sort: str = "quality"  # quality (the score), revenue or discount


def gated(rows: DataFrame, o: Options) -> DataFrame:
    """Candidates that pass the gates, with discount, revenue and score (landing context).
    An image is asked for where the rows have a column for it. Cheap products of low score
    only pass as deals."""
    price, ref = F.col("price"), M.reference_price(F.col("price_avg_90"), F.col("price_avg_30"))
    score = M.desirability(price, F.col("title"), F.col("brand"), F.col("category"), F.col("monthly_sold"), F.col("sales_rank"), F.col("rating"), F.col("review_count"), "landing")
    rows = rows.where((F.col("condition") == "New") & (price >= o.min_price) & (price > 0)).withColumn("discount", F.coalesce(M.discount_rate(price, ref), F.lit(0.0)))
    rows = rows.withColumn("score", score["score"] + F.when(F.col("discount") >= 20, 2 * F.col("discount")).otherwise(0)).withColumn("revenue", score["revenue"])
    if "image_url" in rows.columns:
        rows = rows.where(filled(F.col("image_url")).isNotNull())
    return rows.where("discount > 0" if o.needs_discount else ~((price < 50) & (F.col("score") < 100)))


_KEYS = {"quality": ["score"], "discount": ["discount", "score"], "revenue": ["revenue", "score"]}


def _pick(g: pd.DataFrame, o: Options, shown: set, parents: set) -> list[tuple]:
    """(id, asin) of the rows taken, in their order; what is shown and its parents are passed over, and added to."""
    keys, used, out = _KEYS[o.sort], {}, []
    for r in g.sort_values([*keys, "id"], ascending=[False] * len(keys) + [True]).itertuples():
        parent = r.parent_asin if isinstance(r.parent_asin, str) and r.parent_asin else None
        if r.asin in shown or parent in parents or used.get(r.category, 0) >= o.per_category:
            continue
        shown.add(r.asin)
        if parent:
            parents.add(parent)
        used[r.category] = used.get(r.category, 0) + 1
        out.append((r.id, r.asin))
        if len(out) == o.items:
            break
    return out


def greedy(rows: DataFrame, o: Options, group: str = "country") -> DataFrame:
    """In falling order of the sort key: at most one of a parent group, `per_category`
    of a category, `items` in all; an item passed over for its category doesn't use up
    its parent. One group's candidates are the bounded pools of the caller."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        name = g[group].iloc[0]
        return pd.DataFrame([(name, *x, place + 1) for place, x in enumerate(_pick(g, o, set(), set()))], columns=[group, "id", "asin", "place"])

    return rows.select(group, "id", "asin", "parent_asin", "category", *_KEYS[o.sort]).groupBy(group).applyInPandas(pick, f"{group} string, id long, asin string, place int")


def by_parent(rows: DataFrame, o: Options) -> DataFrame:
    """The same pick where no parent group spans categories: two row_number filters."""
    order = [F.desc("score"), F.col("id")]
    parent = F.coalesce("parent_asin", "asin")
    first = rows.withColumn("_a", F.row_number().over(Window.partitionBy("category", parent).orderBy(*order))).where("_a = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("place") <= o.per_category).drop("_a")


SECTIONS = [
    ("hero", Options(5, 1, 200.0, sort="revenue")), ("bestsellers", Options(10)), ("deals", Options(10, 2, needs_discount=True)), ("arrivals", Options(12, 2)),
]


def home_pages(products: DataFrame, prices: DataFrame, created: str = "created_at", sections: list = SECTIONS) -> DataFrame:
    """country, section, id, asin, place: the front pages of all countries. Each section draws on its pool (deals 80 a country,
    15 a category, newest 60 new ones) without what earlier sections show: not the same product, and no
    other one of the same parent. Products and parents are told apart.

    A country's candidates, which the pools bound, meet in one group; the sections are filled there one after
    another, and carry what is shown from each to the next.
    """
    p = prices.withColumn("price", M.effective_price(F.col("amazon_price"), F.col("new_price"), F.col("used_price")))
    rows = p.join(products, F.col("product_id") == products["id"])
    place = F.row_number().over(Window.partitionBy("country").orderBy(F.desc_nulls_last("drop"), "id"))
    deals = best_deals_by_country(products, prices).withColumn("_n", place).where("_n <= 80").select("country", "id")
    popular, fresh = diverse_popular(products, 15).select("id"), new_arrivals(only_new(products), 60, created).select("id")
    pools = {"hero": (popular, ["id"]), "bestsellers": (popular, ["id"]), "deals": (deals, ["country", "id"]), "arrivals": (fresh, ["id"])}
    cols = ["country", "id", "asin", "parent_asin", "category", "score", "revenue", "discount"]
    candidates = [gated(rows.join(pools[name][0], pools[name][1], "left_semi"), o).select(F.lit(n).alias("section"), *cols) for n, (name, o) in enumerate(sections)]

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        shown, parents, out = set(), set(), []
        for n, (name, o) in enumerate(sections):
            taken = _pick(g[g["section"] == n], o, shown, parents)
            out += [(g["country"].iloc[0], name, *x, k + 1) for k, x in enumerate(taken)]
        return pd.DataFrame(out, columns=["country", "section", "id", "asin", "place"])

    return reduce(DataFrame.unionByName, candidates).groupBy("country").applyInPandas(fill, "country string, section string, id long, asin string, place int")


def home_sections(products: DataFrame, prices: DataFrame, country: str, created: str = "created_at", sections: list = SECTIONS) -> DataFrame:
    """section, id, asin, place of one country's front page."""
    return home_pages(products, prices.where(F.col("country") == country), created, sections).drop("country")
