"""Prices, numbers, links and badges for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import half_up, matched

# Countries as (code, name, domain, currency, symbol, locale, is_live).
COUNTRIES = [
    ("us", "United States", "amazon.com", "USD", "$", "en-US", False),
    ("uk", "United Kingdom", "amazon.co.uk", "GBP", "£", "en-GB", False),
    ("ca", "Canada", "amazon.ca", "CAD", "$", "en-CA", False),
    ("de", "Germany", "amazon.de", "EUR", "€", "de-DE", True),
    ("es", "Spain", "amazon.es", "EUR", "€", "es-ES", False),
    ("it", "Italy", "amazon.it", "EUR", "€", "it-IT", False),
    ("fr", "France", "amazon.fr", "EUR", "€", "fr-FR", False),
]


def _by_country(country: Column, place: int, other: str) -> Column:
    pairs = [F.lit(x) for c in COUNTRIES for x in (c[0], c[place])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(country)), F.lit(other))


def format_number(c: Column, digits: int = 2, comma: Column | None = None) -> Column:
    text = F.format_number(c, digits)
    return text if comma is None else F.when(comma, F.translate(text, ",.", ".,")).otherwise(text)


def format_price(c: Column, country: Column) -> Column:
    """A price in its country's manner; missing prices are a dash."""
    euro = F.lower(country).isin("de", "es", "it", "fr")
    symbol = _by_country(country, 4, "$")
    return F.coalesce(F.when(euro, F.concat(format_number(c, 2, F.lit(True)), F.lit(" "), symbol)).otherwise(F.concat(symbol, format_number(c))), F.lit("–"))


def format_percent(c: Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(format_number(c, digits), F.lit("%")), F.lit("–"))


def format_rating(c: Column) -> Column:
    return F.coalesce(format_number(c, 1, F.lit(True)), F.lit("–"))


def parse_unit_value(c: Column) -> Column:
    return F.coalesce(matched(c, r"([0-9]+(?:\.[0-9]+)?)").try_cast("double"), F.lit(float("inf")))


def affiliate_url(asin: Column, country: Column, tag: Column) -> Column:
    return F.concat(F.lit("https://www."), _by_country(country, 2, "amazon.com"), F.lit("/dp/"), asin, F.lit("?tag="), tag)


def tracked_url(url: Column, campaign: str) -> Column:
    """A listing's address wrapped in the market's tracking redirect."""
    return F.concat(F.lit(f"https://rover.ebay.com/rover/1/{campaign}/1?mpre="), F.url_encode(url))


def redirect_path(slug: Column) -> Column:
    return F.concat(F.lit("/out/"), slug)


def is_bestseller(rank: Column, below: int = 10_000) -> Column:
    return F.coalesce((rank > 0) & (rank < below), F.lit(False))


def savings_label(saved: Column) -> Column:
    return F.when(saved > 0.05, F.concat(F.lit("-"), half_up(saved * 100).cast("long").cast("string"), F.lit("%")))
