"""Expressions on rows made by hand; expected values worked out by hand."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricelode.functions import formatting, metrics, normalize
from pricelode.functions.semantics import first_nonzero, first_present, half_up
from pricelode.plans import detail_queries, ingest, queries  # noqa: F401  the queries register themselves

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.range(1).select(*[v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,price", [("1.299,00 €", 1299.0), ("1,299.00", 1299.0), ("-", None), ("", None), ("1,234,567", 1.234), (None, None)])
def test_parse_price(spark, text, price):
    assert one(spark, normalize.parse_price(F.lit(text).cast("string"))) == price


def test_missing_values(spark):
    a, n, u = F.lit(0.0), F.lit(5.0), F.lit(3.0)
    assert one(spark, first_nonzero(a, n, u)) == 5.0
    assert one(spark, first_present(a, n)) is None
    assert one(spark, half_up(F.lit(-2.5))) == -2.0


def test_feed_values(spark):
    assert one(spark, normalize.cents_to_price(F.lit(12999))) == 129.99
    assert one(spark, normalize.cents_to_price(F.lit(-1))) is None
    assert one(spark, normalize.feed_time(F.lit(0))) == datetime(2011, 1, 1)
    assert one(spark, normalize.parse_count(F.lit("1.000+"))) == 1000
    assert one(spark, normalize.minmax_price(F.lit("[5,1234]"))) == 12.34
    assert one(spark, normalize.parse_float_prefix(F.lit("4.5 stars"))) == 4.5


def test_slug(spark):
    slug = normalize.product_slug(F.lit("Samsung 990 PRO 4TB NVMe..."), F.lit("Samsung"), F.lit("B0CBYZ6DD1"), F.lit(4.0), F.lit("TB"))
    assert one(spark, slug) == "samsung-990-pro-4tb-6dd1"
    assert one(spark, normalize.asin_from_slug(F.lit("x-b0cbyz6dd1"))) == "B0CBYZ6DD1"


def test_noise_goes_in_order(spark):
    rng = random.Random(4)
    words = [*"nvme m.2 m2 lesen interne festplatte hard drive solid state ssd ddr5 ram graphics card gpu (renewed) renewed 16 gb 2 tb 850w 80 plus gold fully modular power supply für gaming und videobearbeitung".split(), "7.450 mb/s", "pcie 4.0", "wd-red", "x", "caf\u00e9", "-"]
    texts = [rng.choice(["", "acme ", "acme acme "]) + rng.choice([" ", "  "]).join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(400)]
    # what is taken out brings together what a later pattern finds
    texts += ["hard nvme drive", "solid ssd state hdd drive", "16 ram gb", "80 gpu plus", "f\u00fcr nvme gaming", "", "   "]

    def plain(low):
        low = low[5:] if low.startswith("acme acme ") else low
        for n in normalize.NOISE:
            low = re.sub(f"(?<![A-Za-z0-9_])(?:{n})(?![A-Za-z0-9_])", " ", low)
        return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", low))

    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "low string").select("low", normalize._words(F.col("low"), F.lit("acme")).alias("words")).collect()
    assert len(rows) == len(texts) + 1
    assert [r["words"] for r in rows] == [None if r["low"] is None else plain(r["low"]) for r in rows]


def test_slugs_are_made_by_all_tasks(spark, tmp_path):
    rows = [(f"B{i:09}", f"Acme Acme Drive X{i} NVMe", "Acme", 4.0, "TB", None) for i in range(5000)]
    spark.createDataFrame(rows, "asin string, title string, brand string, capacity double, capacity_unit string, slug string").coalesce(1).write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    assert stored.rdd.getNumPartitions() == 1
    dealt = ingest.with_slugs(stored)
    got = {r["asin"]: r["slug"] for r in dealt.collect()}
    assert len(got) == 5000 and got["B000000042"] == "acme-drive-x42-4tb-0042"
    for made in (dealt, ingest.regenerated_slugs(stored), queries.QUERIES["product_slugs"](spark, SF), queries.QUERIES["noisy_slugs"](spark, SF), queries.QUERIES["slug_collisions"](spark, SF)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        # the rows are dealt out below the slug's patterns
        assert plan.index("lesen") < plan.index("RepartitionByExpression [asin")


@pytest.mark.parametrize("sub,category", [("Externe Festplatten", "external-storage"), ("Laserdrucker", "laserdrucker"), ("Systemkameras", "systemkameras"), ("Arbeitsspeicher", "ram"), ("Socken", None)])
def test_category(spark, sub, category):
    assert one(spark, normalize.map_category(F.lit("x"), F.lit(sub))) == category


def test_unit_price(spark):
    p = lambda price, cap, unit, cat: one(spark, metrics.price_per_unit(F.lit(price), F.lit(cap), F.lit(unit), F.lit(cat)))
    assert p(230.5, 2.0, "TB", "TB") == 115.25
    assert p(90.0, 500.0, "GB", "TB") == 180.0


def test_discount_and_score(spark):
    assert one(spark, metrics.discount_rate(F.lit(80.0), F.lit(100.0))) == 20
    assert one(spark, metrics.discount_rate(F.lit(10.0), F.lit(100.0))) == 0
    s = metrics.desirability(F.lit(100.0), F.lit("Plain"), F.lit("Sony"), F.lit("cables"), F.lit(15), F.lit(99), F.lit(4.5), F.lit(1001))
    row = one(spark, s)
    assert (row["sales_rank"], row["quality"], row["prestige"], row["tech"]) == (500, 100, 2000, 0)
    assert row["revenue"] == pytest.approx(100**1.5 * 15 * 3 / 15000)


def test_formats(spark):
    assert one(spark, formatting.format_price(F.lit(1234.5), F.lit("de"))) == "1.234,50 €"
    assert one(spark, formatting.format_price(F.lit(1234.5), F.lit("us"))) == "$1,234.50"
    assert one(spark, formatting.format_price(F.lit(None).cast("double"), F.lit("us"))) == "–"
    assert one(spark, formatting.parse_unit_value(F.lit("0.03€/GB"))) == 0.03
    assert one(spark, normalize.reading_time(F.lit(" ".join(["w"] * 201)))) == "2 min read"
    assert [one(spark, normalize.refresh_hours(F.lit(n))) for n in (999, 1000, 5000, 15000)] == [1, 6, 12, 24]
