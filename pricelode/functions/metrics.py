"""Prices, unit prices, discounts and the desirability score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import contains_any, first_nonzero, first_present, half_up


def effective_price(amazon: Column, new: Column, used: Column) -> Column:
    return first_nonzero(amazon, new, used)


def buyable_price(amazon: Column, new: Column) -> Column:
    return first_present(amazon, new)


def buyable_type(amazon: Column) -> Column:
    return F.when(amazon.isNotNull(), "amazon").otherwise("new")


def sync_price(amazon: Column, new: Column, avg90_new: Column) -> Column:
    return first_nonzero(amazon, new, avg90_new)


def _factor(unit: Column, tb: float) -> Column:
    return F.when(F.upper(unit) == "TB", F.lit(float(tb))).otherwise(F.lit(1.0))


def normalized_capacity(capacity: Column, unit: Column, target: Column, tb: float = 1000.0) -> Column:
    """Capacity in the target unit."""
    return capacity * _factor(unit, tb) / _factor(target, tb)


def price_per_unit(price: Column, capacity: Column, unit: Column, category_unit: Column, mode: str = "unit", tb: float = 1000.0) -> Column:
    """Price for one category unit (else the row's own, else GB), two decimals. mode
    "listing" is the price for 1024 MB whatever the unit is called."""
    target = F.coalesce(category_unit, unit, F.lit("GB"))
    size = capacity * _factor(unit, tb) if mode == "listing" else normalized_capacity(capacity, unit, target, tb)
    return F.when((price > 0) & (capacity > 0), half_up(F.try_divide(price, size), 2))


def reference_price(avg90: Column, avg30: Column) -> Column:
    return first_nonzero(avg90, avg30)


def savings(price: Column, reference: Column) -> Column:
    """Fraction saved against the reference; 0 unless that is higher."""
    return F.when(reference > price, F.try_divide(reference - price, reference)).otherwise(0.0)


def discount_rate(price: Column, reference: Column) -> Column:
    """Per cent off the reference; above 80 it is not believed."""
    rate = half_up(F.try_divide(reference - price, reference) * 100)
    return F.when((reference > price) & (rate <= 80), rate).otherwise(0.0)


# Fixed values of the score.
PRESTIGE_BRANDS = [
    "apple", "sony", "bose", "samsung", "sennheiser", "jbl", "nvidia", "asus", "msi", "lg", "microsoft", "google", "panasonic", "philips", "hp",
    "dell", "logitech", "western digital", "sandisk", "nintendo", "canon", "nikon", "playstation", "xbox", "lego",
]
BUDGET_BRANDS = ["xiaomi", "hisense", "tcl", "medion", "teclast", "chuwi"]
ULTRA_TECH = ["oled", "mini-led", "qd-oled", "8k", "neo qled"]
PREMIUM_TECH = ["qled", "pro", "ultra"]
COMMODITY_TECH = ["led", "60hz", "lcd", "ips", "1080p", "hdtv"]
TECH_CATEGORIES = ["tvs", "monitor", "smartphones", "laptop", "gpu", "cpu"]


def desirability(
    price: Column, title: Column, brand: Column, category: Column, monthly_sold: Column, rank: Column, rating: Column, reviews: Column,
    context: str = "category", prestige_brands: list[str] = PRESTIGE_BRANDS,
) -> Column:
    """struct(score, revenue, sales_rank, quality, prestige, tech, penalty)."""
    landing = context == "landing"
    low, brand = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(brand, F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    prestige, premium, ultra = brand.isin(prestige_brands), contains_any(low, PREMIUM_TECH), contains_any(low, ULTRA_TECH)
    sensitive = F.coalesce(category.isin(TECH_CATEGORIES), F.lit(False))
    commodity = ~premium & contains_any(low, COMMODITY_TECH)
    revenue = F.pow(price, F.when(price > 400, 1.7).otherwise(1.5)) * zero(monthly_sold)
    revenue = revenue * F.when(prestige, 5.0 if landing else 3.0).otherwise(1.0) * F.when(prestige & sensitive & commodity, 0.3).otherwise(1.0) / 15000
    r = zero(rank)
    rank_part = F.when((r > 0) & (r < 100), 500).when((r > 0) & (r < 1000), 250).when((r > 0) & (r < 5000), 100).when((r > 0) & (r < 20000), 30).otherwise(0)
    quality = F.when(zero(rating) >= 4.5, 50).otherwise(0) + F.when(zero(reviews) > 1000, 50).when(zero(reviews) > 100, 20).otherwise(0)
    prestige_part = F.when(prestige & sensitive & ~ultra, 500).when(prestige, 2000).otherwise(0)
    tech = F.when(ultra, 3000).when(premium, 1000).when(sensitive & commodity, -2000).otherwise(0)
    budget = brand.isin(BUDGET_BRANDS) | ((brand == "philips") & (price < 500))
    penalty = F.when(budget, -50000 if landing else -20000).otherwise(0)
    return F.struct(
        (revenue + rank_part + quality + prestige_part + tech + penalty).alias("score"), revenue.alias("revenue"), rank_part.alias("sales_rank"),
        quality.alias("quality"), prestige_part.alias("prestige"), tech.alias("tech"), penalty.alias("penalty"),
    )
