"""The stored index, substring search, blocks of ordered groups, daily figures, front pages, paths of the tree."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelode.operators import blocks, catalog, curation, daily, history, listing, search
from pricelode.sources.tables import BucketTable

WORDS = ["solid", "state", "drive", "drivers", "disk", "ssd", "2tb", "4tb", "übergrößen", "ram", "ra", "x"]


def titles(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 7)))) for i in range(n)]


def answers(df):
    return sorted((r["query_id"], r["place"], r["doc"], round(r["score"], 6)) for r in df.collect())


def plain_search(docs, queries, k):
    """BM25 over beginnings of words, by scanning."""
    import math

    toks = {i: t.lower().split() for i, t in docs}
    n, mean = sum(bool(t) for t in toks.values()), sum(map(len, toks.values())) / max(1, sum(bool(t) for t in toks.values()))
    out = []
    for q, text in queries:
        terms = {t for t in text.lower().split() if len(t) >= 2}
        df = {t: sum(any(w.startswith(t) for w in own) for own in toks.values()) for t in terms}
        scored = []
        for i, own in toks.items():
            tf = {t: sum(w.startswith(t) for w in own) for t in terms}
            if terms and all(tf.values()):
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t in terms)
                scored.append((-round(s, 9), i, s))
        out += [(q, place + 1, i, round(s, 6)) for place, (_, i, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


QUERIES = [(1, "dri"), (2, "drive ss"), (3, "übergr ra"), (4, "x"), (5, "none dri"), (6, "di dr so st ss"), (7, ""), (8, "2tb 4tb"), (9, "drivers")]


def test_search_against_a_scan(spark):
    docs = titles(400)
    index = search.build_index(spark.createDataFrame(docs, "id long, title string"), ["title"])
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    for k in (1, 3, 50):  # few are wanted of many: bounds leave documents out
        assert answers(search.search(index, queries, k)) == plain_search(docs, QUERIES, k)
    assert search.search(index.limit(0), queries).count() == 0


def test_stored_index(spark, tmp_path):
    docs = dict(titles(300))
    frame = lambda d: spark.createDataFrame(list(d), "id long, title string")
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = search.StoredIndex(str(tmp_path), 16, 2)
    index.update(frame(docs.items()), ["title"])
    before = {p for p in tmp_path.rglob("*.parquet")}
    size = sum(p.stat().st_size for p in before)
    changed = {5: "drive drive drive", 7: "", 1000: "drivers 2tb"}
    index.update(frame(changed.items()), ["title"], removed=spark.createDataFrame([(9,), (11,), (5000,)], "id long"))
    # what was written is left alone, and the update is small
    new = {p for p in tmp_path.rglob("*.parquet")} - before
    assert all(p.exists() for p in before) and sum(p.stat().st_size for p in new) < size
    docs = {i: t for i, t in (docs | changed).items() if i not in (9, 11)}
    assert answers(index.search(queries, 10)) == plain_search(docs.items(), QUERIES, 10)
    # only the buckets of the asked letters are read
    one = index.read(spark, spark.createDataFrame([("dri",)], "term string"))
    assert len({f.split("_bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1 < len({f.split("_bucket=")[1].split("/")[0] for f in index.read(spark).inputFiles()})
    index.postings.compact(spark, 1)
    assert answers(index.search(queries, 10)) == plain_search(docs.items(), QUERIES, 10)


def test_substrings(spark):
    docs = [*titles(200), (900, None), (901, ""), (902, "SolidState"), (903, "ab"), (904, "a b"), (905, "ababab")]
    words = ["solid", "olidst", "ate", "a", "ab", "bab", "x", "größ", "zzz", "solidzzz", "", "drive", "ssd", "d"]
    texts = spark.createDataFrame([(*d, "x") for d in docs], "id long, title string, word string")
    found = search.contains_any_word(texts.drop("word"), spark.createDataFrame([(w,) for w in words + ["ab"]], "word string"))
    want = {(i, w) for i, t in docs for w in words if w and t is not None and w in t.lower()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    queries = spark.createDataFrame([(1, "Solid  x"), (2, None), (3, "zzz")], "query_id long, query string")
    first = listing.fallback_search(texts, queries, 5).collect()
    assert sorted((r["query_id"], r["place"], r["id"]) for r in first) == [(1, n + 1, i) for n, i in enumerate(sorted(i for i, t in docs if t and ("solid" in t.lower() or "x" in t.lower()))[:5])]


def test_blocks_and_borders(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["big"] * 8 + ["small", None]), float(rng.randint(1, 300)), i) for i in range(1000)] + [("big", None, 5000), ("lone", 1.0, 5001)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    cut = blocks.with_blocks(df, ["g"], "v", 50)
    got = [tuple(r) for r in cut.collect()]
    assert len(got) == len(rows)
    big = [r for r in got if r[0] == "big" and r[1] is not None]
    sizes = {b: sum(r[3] == b for r in big) for b in {r[3] for r in big}}
    assert len(sizes) >= 12 and max(sizes.values()) < 150
    order = sorted(big, key=lambda r: r[1])
    assert all(a[3] <= b[3] and (a[1] != b[1] or a[3] == b[3]) for a, b in zip(order, order[1:]))  # noqa: B905
    # the sum over five rows to either side is that of the whole group
    steps = df.where("v is not null").groupBy("g", "v").agg(F.sum("id").alias("s"))
    around = lambda *by: Window.partitionBy(*by).orderBy("v").rowsBetween(-5, 5)
    want = sorted((tuple(r) for r in steps.select("g", "v", F.sum("s").over(around("g"))).collect()), key=str)
    parts = blocks.with_borders(blocks.with_blocks(steps, ["g"], "v", 3), ["g"], ["v"], 5)
    got = parts.withColumn("t", F.sum("s").over(around("g", "_block"))).where("not _border").select("g", "v", "t")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("block", [5, 50_000])
def test_nearest_prices_in_blocks(spark, block):
    rng = random.Random(4)
    rows = [(i, "a" if i % 4 else "b", float(rng.randint(1, 90))) for i in range(300)]
    want = []
    for i, c, p in rows:
        want += [(i, j, n + 1) for n, (_, j) in enumerate(sorted((abs(q - p), j) for j, d, q in rows if d == c and j != i)[:4])]
    got = listing.similar_products(spark.createDataFrame(rows, "id long, category string, price double"), 4, block)
    assert sorted((r["id"], r["other_id"], r["place"]) for r in got.collect()) == sorted(want)


def test_rolling_figures_in_blocks(spark):
    rng = random.Random(5)
    start = datetime(1996, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, None]), "de", "new", float(rng.randint(100, 999)), start + timedelta(hours=6 * rng.randint(0, 8000))) for _ in range(800)]
    rows += [(3, "de", "new", 5.0, start), (3, "de", "new", 4.0, start + timedelta(days=2000)), (3, "de", "new", None, start + timedelta(days=2001))]
    df = spark.createDataFrame(rows, "product_id long, country string, price_type string, price double, recorded_at timestamp")
    t = F.unix_seconds("recorded_at")
    by = Window.partitionBy("product_id", "country", "price_type").orderBy(t)
    plain = df.select(
        "*", F.round(F.avg("price").over(by.rangeBetween(-30 * 86400, 0)), 6), F.round(F.avg("price").over(by.rangeBetween(-90 * 86400, 0)), 6),
        F.min("price").over(by.rangeBetween(Window.unboundedPreceding, 0)), F.max("price").over(by.rangeBetween(Window.unboundedPreceding, 0)),
    )
    got = history.rolling_price_stats(df)
    assert got.columns == [*df.columns, "avg30", "avg90", "low", "high"]
    got = got.withColumn("avg30", F.round("avg30", 6)).withColumn("avg90", F.round("avg90", 6))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, plain.collect())))
    # each point is dealt to its window once, and nothing is joined to it
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_without_sorts(spark, tmp_path):
    table = BucketTable(str(tmp_path), ("k",), (), 2)
    for v in (1, 2):
        table.append(spark.createDataFrame([(i, v, 0.5 * v) for i in range(5 * v)], "k long, a long, b double"))
    rows = table.read(spark)
    # figures alone are kept in hash tables; of each key the row written last counts
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [(i, 2, 1.0) for i in range(10)]


def test_daily_figures(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(rng.randint(1, 5), "de", rng.choice(["amazon", "used"]), rng.randint(100, 999) / 100, start + timedelta(hours=12 * rng.randint(0, 200))) for _ in range(500)]
    rows += [(1, "de", "amazon", None, start), (1, "de", "amazon", 1.0, None)]
    df = spark.createDataFrame(rows, "product_id long, country string, price_type string, price double, recorded_at timestamp")
    table = daily.daily_table(str(tmp_path), 4)
    for n in range(3):
        part = df.where(F.coalesce(F.pmod(F.xxhash64("price"), F.lit(3)), F.lit(0)) == n)
        assert daily.add_history(table, part, f"b{n}") and not daily.add_history(table, part, f"b{n}")
    kept = table.read(spark)
    names = sorted(kept.columns)
    assert sorted(map(str, map(tuple, kept.select(names).collect()))) == sorted(map(str, map(tuple, daily.daily_figures(df).select(names).collect())))
    prices = spark.createDataFrame([(i, "de", 5.0) for i in range(1, 6)], "product_id long, country string, now double")
    since, until = F.lit("2024-01-11").cast("timestamp"), F.lit("2024-03-11").cast("timestamp")
    a, b = history.analyze_prices(df, prices, F.col("now"), since, until), daily.analyze_daily(kept, prices, F.col("now"), since, until)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and b.count() == 5
    assert max(r["n"] for r in kept.where("price_type = 'amazon'").groupBy("product_id").agg(F.countDistinct("day").alias("n")).collect()) <= 101


def test_front_pages_against_plain(spark):
    rng = random.Random(7)
    products = [
        (i, f"A{i}", None if i % 3 else f"P{i % 12}", f"c{i % 9}", f"t{i} " + rng.choice(["OLED", "Pro", "plain", "Renewed"]), "b", rng.choice(["New", "New", "Used"]), rng.choice([None, 50, 5000, 20000]),
         rng.randint(0, 900), rng.randint(0, 500), rng.choice([3.0, 4.6]), rng.randint(1, 400))
        for i in range(200)
    ]
    prices = [(i, c, rng.choice([None, 20.0, 150.0, 300.0, 800.0]), rng.choice([None, 100.0]), None, rng.choice([None, 200.0, 900.0]), None) for i in range(200) for c in ("de", "fr", "us") if rng.random() < 0.8]
    p = spark.createDataFrame(products, "id long, asin string, parent_asin string, category string, title string, brand string, condition string, sales_rank int, monthly_sold int, review_count int, rating double, created int")
    q = spark.createDataFrame(prices, "product_id long, country string, amazon_price double, new_price double, used_price double, price_avg_90 double, price_avg_30 double")
    got = curation.home_pages(p, q, "created")
    assert "LocalTableScan" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(tuple(r) for r in got.collect())
    # plain: gates by the library, everything else anew
    want = []
    for country in ("de", "fr", "us"):
        new = [r for r in products if r[6] == "New" and "Renewed" not in r[4]]
        popular = set()
        for c in {r[3] for r in new}:
            popular |= {r[0] for r in sorted((r for r in new if r[3] == c), key=lambda r: (r[7] or 10_000_000, -r[9], r[0]))[:15]}
        fresh = {r[0] for r in sorted(new, key=lambda r: (-r[11], r[0]))[:60]}
        drops = []
        for i, c, own, other, _, ref, _ in prices:
            if c == country and any(r[0] == i for r in new) and (ref or 0) > 0 and ((own or 0) > 0 or (other or 0) > 0):
                now = own if own is not None else other
                drops.append((-(ref - now) / ref, i))
        deals = {i for _, i in sorted(drops)[:80]}
        shown, parents = set(), set()
        for (name, o), pool in zip(curation.SECTIONS, (popular, popular, deals, fresh), strict=True):
            rows = q.where(F.col("country") == country).withColumn("price", F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in ("amazon_price", "new_price", "used_price")])).join(p, F.col("product_id") == F.col("id"))
            left = [r for r in curation.gated(rows, o).collect() if r["id"] in pool]
            key = {"revenue": lambda r: (-r["revenue"], -r["score"], r["id"]), "quality": lambda r: (-r["score"], r["id"])}[o.sort]
            used, n = {}, 0
            for r in sorted(left, key=key):
                if n == o.items or r["asin"] in shown or r["parent_asin"] in parents or used.get(r["category"], 0) >= o.per_category:
                    continue
                n += 1
                want.append((country, name, r["id"], r["asin"], n))
                shown.add(r["asin"])
                parents |= {r["parent_asin"]} - {None}
                used[r["category"]] = used.get(r["category"], 0) + 1
    assert found == sorted(want) and len({r[0] for r in found}) == 3 and len(found) > 30
    assert sorted(tuple(r) for r in curation.home_sections(p, q, "de", "created").collect()) == sorted(w[1:] for w in want if w[0] == "de")


def test_paths_of_any_depth(spark):
    tree = lambda rows: spark.createDataFrame(rows, "slug string, parent string, name string")
    deep = [(f"n{i}", f"n{i - 1}" if i else None, "x") for i in range(40)] + [("orphan", "gone", "x"), ("child", "orphan", "x")]
    got = {r["slug"]: r["path"] for r in catalog.category_paths(tree(deep)).collect()}
    assert got["n39"] == [f"n{i}" for i in range(40)] and got["child"] == ["orphan", "child"] and len(got) == len(deep)
    with pytest.raises(Exception, match="is its own ancestor"):
        catalog.category_paths(tree([("a", "b", "x"), ("b", "a", "x"), ("c", None, "x")])).collect()
    assert catalog.category_paths(tree([])).count() == 0


def test_many_queries_of_the_same_words(spark):
    docs = titles(120)
    frame = spark.createDataFrame(docs, "id long, title string")
    asked = spark.createDataFrame([(i, "drive ss" if i % 2 else "ss drive") for i in range(40)], "query_id long, query string")
    # queries of the same terms are one: no row of a query and a document but the best
    found = search.search(search.build_index(frame, ["title"]), asked, 3)
    assert answers(found) == plain_search(docs, [(r["query_id"], r["query"]) for r in asked.collect()], 3)
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert windows and not any("query_id" in line for line in windows)
    # of each word only the first k products meet the queries
    first = listing.fallback_search(frame, asked, 3)
    want = sorted(i for i, t in docs if "drive" in t.lower() or "ss" in t.lower())[:3]
    assert sorted((r["query_id"], r["id"], r["place"]) for r in first.collect()) == [(q, i, n + 1) for q in range(40) for n, i in enumerate(want)]
    assert "WindowGroupLimit [word" in first._jdf.queryExecution().optimizedPlan().toString()


def test_fallback_search_broadcasts_nothing(spark, tmp_path):
    docs = titles(60)
    spark.createDataFrame(docs, "id long, title string").write.parquet(f"{tmp_path}/docs")
    queries = [(i, ("drive ss", "solid 2", "zzz")[i % 3]) for i in range(9)]
    spark.createDataFrame(queries, "query_id long, query string").write.parquet(f"{tmp_path}/asked")
    frame, asked = spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/asked")
    found = listing.fallback_search(frame, asked, 4)
    # files this small would be broadcast if the joins went by their size
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(q, i, n + 1) for q, words in queries for n, i in enumerate(sorted(i for i, t in docs if any(w in t.lower() for w in words.split()))[:4])]
    assert want and sorted(tuple(r) for r in found.select("query_id", "id", "place").collect()) == sorted(want)


def test_stored_search_brings_postings_together_once(spark, tmp_path):
    docs = dict(titles(200))
    frame = lambda d: spark.createDataFrame(list(d), "id long, title string")
    index = search.StoredIndex(str(tmp_path), 4, 2)
    index.update(frame(docs.items()), ["title"])
    index.update(frame([(3, "drive only"), (4, "onlyhere ss")]), ["title"])
    index.update(frame([(4, "drive ss")]), ["title"])  # a token that no document has any more
    docs |= {3: "drive only", 4: "drive ss"}
    asked = [(i, ("drive ss", "ss drive", "only", "onlyhere")[i % 4]) for i in range(40)]
    found = index.search(spark.createDataFrame(asked, "query_id long, query string"), 3)
    assert answers(found) == plain_search(docs.items(), asked, 3)
    # the rows of a key are brought together for the postings alone, not for the tokens that terms are looked up among
    merged = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "max_by(tf" in line]
    assert merged and all("max_by(length" in line for line in merged)
    assert {r["token"] for r in index.postings.values(spark, ["token"]).collect()} >= {r["token"] for r in index.read(spark).select("token").distinct().collect()}


def test_first_pages_in_one_pass(spark):
    rng = random.Random(8)
    draw = lambda: rng.choice([None, *[float(x) for x in range(6)]])
    rows = [(i, draw(), draw(), draw(), datetime(2024, 1, 1 + i % 9).date() if i % 5 else None, draw(), draw()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, price double, unit_price double, savings double, created_at date, score double, normalized_capacity double")
    pages = listing.first_pages(df, 50)
    got = {(r["sort"], r["place"]): r["id"] for r in pages.collect()}
    for name in ("price", "newest", "savings"):
        assert [got[name, n + 1] for n in range(50)] == [r["id"] for r in listing.sort_listing(df, name).limit(50).collect()]
    assert len(got) == 50 * len(listing.SORTS) and "Union" not in pages._jdf.queryExecution().optimizedPlan().toString()
