"""Product sources by name: how each is read, and what its products must look like.

Whatever a source is read from, its products have the columns of PRODUCT; those that it lacks are null. A
name that is not registered, a file that lacks a needed column or has it in another type, fails
before any job runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.normalize import decode_stats
from ..operators import merge
from . import readers

#: What all sources give.
PRODUCT = (
    "id string not null, source string not null, title string, brand string, category string, image_url string, url string, price double, shipping_cost double, condition string, availability string, "
    "rating double, review_count long, last_updated timestamp"
)


@dataclass(frozen=True)
class Source:
    """read: (spark, path, country) to the source's own rows; products: these rows to products. needs: the columns, with types,
    that its rows must have."""

    name: str
    read: Callable[[SparkSession, str, str], DataFrame]
    products: Callable[[DataFrame, str], DataFrame]
    needs: str


def _feed(rows: DataFrame, country: str) -> DataFrame:
    d = decode_stats(rows)
    return d.select(
        F.col("asin").alias("id"), "title", F.coalesce("brand", "manufacturer").alias("brand"), F.coalesce("amazon_price", "new_price").alias("price"), F.lit("new").alias("condition"),
        "rating", "review_count", F.lit("keepa").alias("source"),
    )


# The names of the sources, in the order in which they are asked.
SOURCES = {
    s.name: s
    for s in (
        Source("keepa", lambda spark, path, country: readers.read_feed_json(spark, path), _feed, "asin string, title string, stats struct<current:array<bigint>>"),
        Source("amazon-paapi", lambda spark, path, country: readers.read_paapi_json(spark, path), lambda rows, country: merge.paapi_products(rows), "asin string, price double, availability string"),
        Source("ebay", lambda spark, path, country: readers.read_ebay_json(spark, path), lambda rows, country: merge.ebay_products(rows), "item_id string, price double, condition_id string"),
        Source("static", lambda spark, path, country: readers.read_static_json(spark, path, country), merge.static_products, "asin string, title string, prices struct<>"),
    )
}


def source(name: str) -> Source:
    if name not in SOURCES:
        raise ValueError(f"no source is called {name!r}; there are {', '.join(SOURCES)}")
    return SOURCES[name]


def checked(rows: DataFrame, needs: str, of: str) -> DataFrame:
    """`rows`, if they have the needed columns in their types; fields of a needed struct must be there, others may be."""
    faults = []
    for want in StructType.fromDDL(needs):
        have = next((f for f in rows.schema if f.name == want.name), None)
        if have is None:
            faults.append(f"{want.name} is missing")
        elif isinstance(want.dataType, StructType):
            inner = {f.name: f.dataType for f in have.dataType} if isinstance(have.dataType, StructType) else None
            if inner is None or any(inner.get(f.name) != f.dataType for f in want.dataType):
                faults.append(f"{want.name} is {have.dataType.simpleString()}, not {want.dataType.simpleString()}")
        elif have.dataType != want.dataType:
            faults.append(f"{want.name} is {have.dataType.simpleString()}, not {want.dataType.simpleString()}")
    if faults:
        raise ValueError(f"{of}: {'; '.join(faults)}")
    return rows


def products_of(spark: SparkSession, name: str, path: str, country: str = "de") -> DataFrame:
    """A source's products, with the columns of PRODUCT."""
    s = source(name)
    rows = s.products(checked(s.read(spark, path, country), s.needs, name), country)
    none = lambda f: F.lit(None).cast(f.dataType)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else none(f)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(PRODUCT)])


def merged_products(spark: SparkSession, paths: dict[str, str], country: str = "de") -> DataFrame:
    """One row for each product id of several sources (name to path), which count in the order of SOURCES."""
    for name in paths:
        source(name)
    parts = [products_of(spark, name, paths[name], country) for name in SOURCES if name in paths]
    return merge.merge_sources(parts, ["title", "brand", "category", "image_url", "rating", "review_count"])


def first_products(spark: SparkSession, paths: dict[str, str], country: str = "de") -> DataFrame:
    """Each product id from the first source that has it."""
    for name in paths:
        source(name)
    return merge.first_available([products_of(spark, name, paths[name], country) for name in SOURCES if name in paths])
