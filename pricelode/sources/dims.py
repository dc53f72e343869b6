"""Small dimensions: the category tree and the countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.formatting import COUNTRIES

# The category tree; (slug, parent, unit, hidden).
CATEGORIES = [
    ("haushaltselektronik", "elektroartikel", None, True),
    ("computer", "elektroartikel", None, False),
    ("telekommunikation", "elektroartikel", None, False),
    ("apple-iphone", "telekommunikation", None, False),
    ("samsung-galaxy", "telekommunikation", None, False),
    ("hifi-audio", "elektroartikel", None, False),
    ("tv-sat", "elektroartikel", None, False),
    ("fotografie", "elektroartikel", None, False),
    ("drucker-scanner", "elektroartikel", None, False),
    ("gaming-elektrospielzeug", "elektroartikel", None, False),
    ("elektroartikel", None, None, False),
    ("electronics", None, None, True),
    ("tvs", "elektroartikel", None, False),
    ("staubsauger", "elektroartikel", None, True),
    ("headphones", "elektroartikel", None, False),
    ("notebooks", "elektroartikel", None, False),
    ("tablets", "elektroartikel", None, False),
    ("espressomaschinen", "elektroartikel", None, True),
    ("monitors", "elektroartikel", None, False),
    ("speakers", "elektroartikel", None, False),
    ("kuehlschraenke", "elektroartikel", None, True),
    ("elektrische-zahnbuersten", "elektroartikel", None, True),
    ("waschmaschinen", "elektroartikel", None, True),
    ("multifunktionsdrucker", "drucker-scanner", None, False),
    ("geschirrspueler", "elektroartikel", None, True),
    ("routers", "elektroartikel", None, False),
    ("systemkameras", "fotografie", None, False),
    ("backoefen", "elektroartikel", None, True),
    ("kochfelder", "elektroartikel", None, True),
    ("soundbars", "elektroartikel", None, False),
    ("radios", "elektroartikel", None, False),
    ("waeschetrockner", "elektroartikel", None, True),
    ("kuechenmaschinen", "elektroartikel", None, True),
    ("bartschneider-haarschneider", "elektroartikel", None, True),
    ("receiver", "elektroartikel", None, False),
    ("mikrowellen", "elektroartikel", None, True),
    ("dunstabzugshauben", "elektroartikel", None, True),
    ("hard-drives", "elektroartikel", "TB", False),
    ("gefrierschraenke", "elektroartikel", None, True),
    ("herde", "elektroartikel", None, True),
    ("drones", "gaming-elektrospielzeug", None, False),
    ("nas", "elektroartikel", None, False),
    ("pc-komponenten", "computer", None, False),
    ("gpu", "pc-komponenten", "GB", False),
    ("motherboards", "pc-komponenten", None, False),
    ("ram", "pc-komponenten", "GB", False),
    ("pc-cases", "pc-komponenten", None, False),
    ("power-supplies", "pc-komponenten", "W", False),
    ("cpu-coolers", "pc-komponenten", None, False),
    ("storage", "pc-komponenten", None, False),
    ("ssds", "elektroartikel", "TB", False),
    ("smartwatch-accessories", "telekommunikation", None, False),
    ("smartphones", "telekommunikation", None, False),
    ("smartwatches", "telekommunikation", None, False),
    ("consoles", "gaming-elektrospielzeug", None, False),
    ("cameras", "fotografie", None, False),
    ("keyboards", "computer", None, False),
    ("mice", "computer", None, False),
    ("mouse-pads", "computer", None, False),
    ("external-storage", "storage", "TB", False),
    ("speicherkarten", "fotografie", "GB", False),
    ("docking-stations", "computer", None, False),
    ("network-switches", "computer", None, False),
    ("network-cards", "computer", None, False),
    ("cables", "computer", None, False),
    ("laptop-stands", "computer", None, False),
    ("ups", "computer", None, False),
    ("cable-management", "computer", None, False),
    ("monitor-arms", "computer", None, False),
    ("desk-accessories", "computer", None, False),
    ("office-chairs", "computer", None, False),
    ("standing-desks", "computer", None, False),
    ("tablet-accessories", "computer", None, False),
    ("phone-accessories", "telekommunikation", None, False),
    ("game-controllers", "gaming-elektrospielzeug", None, False),
    ("vr-headsets", "gaming-elektrospielzeug", None, False),
    ("microphones", "hifi-audio", None, False),
    ("gaming-chairs", "gaming-elektrospielzeug", None, False),
    ("webcams", "computer", None, False),
    ("capture-cards", "computer", None, False),
    ("cpu", "pc-komponenten", "core", False),
    ("elektrowerkzeuge", None, None, True),
    ("akkuschrauber", "elektrowerkzeuge", None, True),
    ("bohrmaschinen", "elektrowerkzeuge", None, True),
    ("kreissaegen", "elektrowerkzeuge", None, True),
    ("schleifmaschinen", "elektrowerkzeuge", None, True),
    ("fraesmaschinen", "elektrowerkzeuge", None, True),
    ("3d-drucker", "drucker-scanner", None, False),
    ("laserdrucker", "drucker-scanner", None, False),
    ("kompaktkameras", "fotografie", None, False),
]


def categories(spark: SparkSession, rows: list[tuple] = CATEGORIES) -> DataFrame:
    return spark.createDataFrame(rows, "slug string, parent string, unit_type string, hidden boolean")


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, "code string, name string, domain string, currency string, symbol string, locale string, is_live boolean")
