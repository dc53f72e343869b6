"""Feed values to catalogue values. All are built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import BORDER_LEFT, BORDER_RIGHT, contains_any, filled, let, matched

FEED_EPOCH = 1293840000  # 2011-01-01T00:00:00Z


def cents_to_price(c: Column) -> Column:
    return F.when(c >= 0, c / 100.0)


def feed_time(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(FEED_EPOCH) + minutes * 60)


# Places of the feed's current figures.
STATS = {"amazon": 0, "new": 1, "used": 2, "sales_rank": 3, "list": 4, "warehouse": 9, "offers_new": 11, "offers_used": 12, "rating": 16, "review_count": 17}


def decode_stats(df: DataFrame, current: str = "stats.current") -> DataFrame:
    """Adds the figures of `current`; prices in cents become prices, counts and ranks
    of 0 or less are missing, ratings are tenths."""
    at = lambda k: F.get(F.col(current), F.lit(STATS[k]))
    prices = {f"{k}_price": cents_to_price(at(k)) for k in ("amazon", "new", "used", "list", "warehouse")}
    counts = {k: F.when(at(k) > 0, at(k)) for k in ("sales_rank", "offers_new", "offers_used", "review_count")}
    return df.withColumns(prices | counts | {"rating": F.when(at("rating") > 0, at("rating") / 10.0)})


def minmax_price(entry: Column) -> Column:
    """An entry, as text, that is cents or a [time, cents] pair."""
    pair = F.get(F.from_json(entry, "array<bigint>"), F.lit(1))
    return cents_to_price(F.when(entry.startswith("["), pair).otherwise(entry.try_cast("bigint")))


def latest_rank(ranks: Column) -> Column:
    """The last [time, rank] pair of the first category."""
    pairs = F.get(F.map_values(ranks), F.lit(0))
    return F.get(F.try_element_at(pairs, F.lit(-1)), F.lit(1))


def parse_float_prefix(c: Column) -> Column:
    return matched(c, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))").try_cast("double")


def parse_count(c: Column) -> Column:
    """The digits of a text as a number; none or 0 is missing."""
    n = F.regexp_replace(c, r"[^0-9]", "").try_cast("long")
    return F.nullif(n, F.lit(0).cast("long"))


def parse_price(c: Column) -> Column:
    """Localised price: whichever of comma and dot comes last is the decimal point."""
    return let(F.regexp_replace(c, r"[^0-9,.]", ""), _decimal)


def _decimal(kept: Column) -> Column:
    comma, dot = F.instr(F.reverse(kept), ","), F.instr(F.reverse(kept), ".")
    comma_last = (comma > 0) & ((dot == 0) | (comma < dot))
    point = F.replace(kept, F.lit("."), F.lit(""))
    at = F.instr(point, ",")
    german = F.concat(point.substr(F.lit(1), at - 1), F.lit("."), point.substr(at + 1, F.length(point)))
    return parse_float_prefix(F.when(comma_last, german).otherwise(F.replace(kept, F.lit(","), F.lit(""))))


# Category rules, the first hit wins: (category, test, words, none of these).
# sub: any of the words is in the lower-case sub-category; both: all of them are; begins: it
# begins with one; root: one is in the root category; root_is: one is the root category.
CATEGORY_RULES = [
    ("notebooks", "sub", ["normale laptops", "notebooks", "macbooks"], []),
    ("gpu", "sub", ["grafikkarten"], []),
    ("cpu", "sub", ["prozessoren", "cpus"], []),
    ("monitors", "sub", ["monitore"], []),
    ("keyboards", "sub", ["tastaturen"], []),
    ("mice", "sub", ["mäuse", "mice"], []),
    ("tablets", "sub", ["tablets"], []),
    ("routers", "sub", ["router"], []),
    ("3d-drucker", "sub", ["3d-drucker", "3d-druck"], []),
    ("laserdrucker", "sub", ["laser"], []),
    ("multifunktionsdrucker", "sub", ["drucker", "inkjet", "tintenstrahl", "multifunktions", "all-in-one"], []),
    ("systemkameras", "sub", ["systemkamera"], []),
    ("kompaktkameras", "sub", ["kompaktkamera"], []),
    ("cameras", "sub", ["spiegelreflex", "kamera", "camera", "photo"], []),
    ("smartphones", "sub", ["handy", "smartphone"], []),
    ("smartwatches", "sub", ["watch", "uhr"], []),
    ("ssds", "sub", ["solid state drives", "ssd"], ["extern"]),
    ("hard-drives", "sub", ["festplatten"], ["extern"]),
    ("hard-drives", "both", ["interner speicher", "festplatten"], []),
    ("external-storage", "sub", ["externe datenspeicher", "externe festplatten", "externe solid state drives", "externer speicher"], []),
    ("headphones", "sub", ["headphones", "kopfhörer", "ohrhörer", "headset"], []),
    ("tvs", "sub", ["fernseher", "tvs", "tv-geräte"], []),
    ("ram", "sub", ["arbeitsspeicher", "ram"], []),
    ("speakers", "sub", ["lautsprecher", "speakers"], []),
    ("consoles", "sub", ["konsolen", "consoles"], []),
    ("consoles", "root_is", ["Games"], []),
    ("consoles", "begins", ["games"], []),
    ("power-supplies", "sub", ["netzteile", "psu"], []),
    ("pc-cases", "sub", ["gehäuse", "cases"], []),
    ("motherboards", "sub", ["mainboards", "motherboards"], []),
    ("cpu-coolers", "sub", ["lüfter", "kühler", "coolers"], []),
    ("staubsauger", "sub", ["staubsauger"], []),
    ("kuechenmaschinen", "sub", ["küchenmaschinen"], []),
    (
        "speicherkarten",
        "sub",
        ["speicherkarten", "micro sd", "sdhc", "sdxc", "memory card", "cfexpress", "compactflash", "compact flash", "securedigital", "sd card", "sd-karte"],
        [],
    ),
    ("computer", "root", ["Computer"], []),
    ("computer", "sub", ["computer"], []),
]


def map_category(root: Column, sub: Column, rules: list = CATEGORY_RULES) -> Column:
    """Category of a feed row; null if no rule holds."""
    return let(F.struct(F.lower(F.coalesce(sub, F.lit(""))).alias("low"), F.coalesce(root, F.lit("")).alias("root")), lambda t: _first_rule(t["root"], t["low"], rules))


def _first_rule(root: Column, low: Column, rules: list) -> Column:
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    tests = {
        "sub": lambda words: contains_any(low, words),
        "both": lambda words: reduce(lambda a, b: a & b, [low.contains(w) for w in words]),
        "begins": lambda words: any_of([low.startswith(w) for w in words]),
        "root": lambda words: contains_any(root, words),
        "root_is": lambda words: any_of([root == w for w in words]),
    }
    hits = [F.when(tests[test](words) & ~contains_any(low, none_of) if none_of else tests[test](words), name) for name, test, words, none_of in rules]
    return F.coalesce(*hits)


def collect_filled(columns: list[str]) -> Column:
    """The values of the columns that are neither null nor empty, in order."""
    return F.filter(F.array(*[F.col(f"`{c}`") for c in columns]), lambda x: x.isNotNull() & (x != ""))


def collect_specs(columns: list[str]) -> Column:
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*map(filled, columns))


def condition_of(title: Column, condition: Column) -> Column:
    marked = contains_any(title, ["Generalüberholt", "Renewed", "Refurbished", "generalüberholt", "renewed", "refurbished", "erneuert"])
    return F.when(F.coalesce(marked, F.lit(False)), "Used").otherwise(F.coalesce(filled(condition), F.lit("New")))


def _mapped(c: Column, table: dict[str, str], other: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(other))


# Condition and availability codes.
_EBAY = {"1000": "new", "1500": "new"} | dict.fromkeys(["2000", "2010", "2020", "2030", "2500"], "refurbished")
_PAAPI = {"new": "new", "used": "used", "refurbished": "renewed", "renewed": "renewed"}
_AVAILABILITY = {"Now": "in_stock", "OutOfStock": "out_of_stock", "PreOrder": "preorder"}


def map_ebay_condition(c: Column) -> Column:
    return _mapped(c, _EBAY, "used")


def map_paapi_condition(c: Column) -> Column:
    return _mapped(F.lower(c), _PAAPI, "new")


def map_availability(c: Column) -> Column:
    return _mapped(c, _AVAILABILITY, "unknown")


def extract_capacity(title: Column, unit: Column) -> Column:
    """struct(capacity, capacity_unit) read from a title; cores for the unit `core`."""
    size = r"(?i)([0-9]+)\s?(GB|TB)"
    cores = r"(?i)([0-9]+)\s?-?\s?(Core|Kerne)"
    return F.when(
        unit == "core", F.struct(matched(title, cores).try_cast("double").alias("capacity"), F.lit("core").alias("capacity_unit"))
    ).otherwise(F.struct(matched(title, size).try_cast("double").alias("capacity"), F.upper(matched(title, size, 2)).alias("capacity_unit")))


def split_capacity(c: Column) -> Column:
    p = r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)$"
    return F.struct(matched(c, p).try_cast("double").alias("capacity"), F.upper(matched(c, p, 2)).alias("capacity_unit"))


def cpu_attributes(title: Column, specs: Column) -> Column:
    """struct(socket, cores) from the spec map, else the title, in upper case."""
    socket = F.coalesce(filled(F.try_element_at(specs, F.lit("Socket"))), matched(title, r"(?i)(AM[45]|LGA\s?[0-9]{4}|sTRX4|sWRX8)"))
    cores = F.coalesce(filled(F.try_element_at(specs, F.lit("Cores"))), matched(title, r"(?i)([0-9]+)\s?-?\s?(?:Core|Kerne)"))
    return F.struct(F.upper(F.regexp_replace(socket, r"\s", "")).alias("socket"), F.upper(cores).alias("cores"))


# Pieces of titles that say nothing in a slug, taken out in this order.
NOISE = [
    r"nvme", r"m\.?2", r"pcie\s*[0-9.]+", r"[0-9.,]+\s*mb/?s", r"lesen", r"schreiben", r"interne?", r"externe?", r"festplatte", r"hard\s*drive",
    r"solid\s*state\s*drive", r"ssd", r"hdd", r"ddr[45]", r"sodimm", r"dimm", r"ram", r"speicher", r"memory", r"grafikkarte", r"graphics\s*card",
    r"gpu", r"\(?generalüberholt\)?", r"\(?renewed\)?", r"\(?refurbished\)?", r"[0-9]+\s*gb", r"[0-9]+\s*tb", r"[0-9]+\s*w", r"80\s*plus",
    r"platinum", r"gold", r"bronze", r"modular", r"fully", r"semi", r"atx", r"sfx", r"netzteil", r"power\s*supply", r"psu", r"für\s+gaming",
    r"und\s+videobearbeitung", r"für\s+[A-Za-z0-9_]+", r"[a-z]{2,3}-[a-z0-9]+",
]
NOISE_RUN = 7  # patterns looked for at once


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def product_slug(title: Column, brand: Column, asin: Column, capacity: Column, unit: Column) -> Column:
    """brand, cleaned title cut at 45, capacity, last four of the ASIN, joined by dashes."""
    given = F.struct(capacity.cast("double").alias("c"), F.lower(unit).alias("u"))
    parts = F.struct(F.lower(title).alias("low"), F.lower(filled(brand)).alias("b"), F.when(F.lower(unit).isin("tb", "gb", "w", "zoll"), given).otherwise(F.coalesce(*_sizes(title), given)).alias("size"), asin.alias("asin"))
    return let(parts, lambda p: let(F.struct(_words(p["low"], p["b"]).alias("words"), F.regexp_replace(p["b"], r"[^a-z0-9]+", "-").alias("prefix")), lambda w: _slug(w["words"], w["prefix"], p["size"], p["asin"])))


def _sizes(title: Column) -> list[Column]:
    """Sizes that a title shows: storage, screen, power."""
    number, out = r"([0-9]+(?:\.[0-9]+)?)", []
    for pattern, name in ((number + r"\s*(TB|GB)", None), (number + r"""\s*(?:Zoll|"|inches?)""", "zoll"), (r"([0-9]+)\s*W(?:att)?(?:\s|,|$)", "w")):
        found = matched(title, "(?i)" + pattern)
        out.append(F.when(found.isNotNull(), F.struct(found.try_cast("double").alias("c"), (F.lit(name) if name else F.lower(matched(title, "(?i)" + pattern, 2))).alias("u"))))
    return out


def _words(low: Column, brand: Column) -> Column:
    """A title in lower case without a doubled brand and without noise, dashed."""
    twice = F.concat(brand, F.lit(" "), brand, F.lit(" "))
    once = F.when(F.coalesce(F.startswith(low, twice), F.lit(False)), low.substr(F.length(brand) + 2, F.length(low))).otherwise(low)
    whole = lambda n: f"{BORDER_LEFT}(?:{n}){BORDER_RIGHT}"
    for i in range(0, len(NOISE), NOISE_RUN):
        run = NOISE[i : i + NOISE_RUN]
        # a text in which no pattern of a run is found stays as it is, since none of them changes it for the next
        once = let(once, lambda t: F.when(t.rlike(whole("|".join(run))), reduce(lambda c, n: F.regexp_replace(c, whole(n), " "), run, t)).otherwise(t))  # noqa: B023
    return _dashed(once)


def _slug(words: Column, prefix: Column, size: Column, asin: Column) -> Column:
    text = F.when(size["c"] % 1 == 0, size["c"].cast("long").cast("string")).otherwise(F.format_string("%.1f", size["c"]))
    suffix = F.when((size["c"] != 0) & (size["u"] != ""), F.concat(text, size["u"]))

    def short(base: Column) -> Column:
        head = F.substring(base, 1, 45)
        last = F.length(head) - F.instr(F.reverse(head), "-")  # place of the last dash, from 0
        cut = F.when((F.instr(head, "-") > 0) & (last > 20), head.substr(F.lit(1), last)).otherwise(head)
        return F.when(F.length(base) > 45, cut).otherwise(base)

    def ended(base: Column) -> Column:
        sized = F.when(suffix.isNull() | base.contains(suffix), base).otherwise(F.concat(base, F.lit("-"), suffix))
        return F.when(F.length(asin) >= 4, F.concat(sized, F.lit("-"), F.lower(F.substring(asin, -4, 4)))).otherwise(sized)

    base = F.when(prefix.isNull() | words.startswith(prefix), words).otherwise(F.concat(prefix, F.lit("-"), words))
    return F.regexp_replace(F.regexp_replace(let(let(base, short), ended), "-+", "-"), r"^-|-$", "")


def asin_from_slug(c: Column) -> Column:
    return F.upper(matched(c, r"([A-Za-z0-9]{10})$"))


def display_title(title: Column, model: Column) -> Column:
    head = F.trim(F.get(F.split(title, r" - | \(| \||, "), F.lit(0)))
    return F.when(F.length(head) > 3, head).otherwise(F.coalesce(filled(model), title, F.lit("")))


def image_url(c: Column, width: int = 250, style: str = "tag") -> Column:
    """`tag` replaces the size tag, `inject` strips any modifier and puts the width in."""
    if style == "tag":
        new = F.regexp_replace(c, r"\._AC_S[XY][0-9]+_", f"._AC_SX{width}_")
    else:
        new = F.regexp_replace(c, r"^(.*?)(?:\._[A-Za-z0-9_]+_)?(\.[A-Za-z0-9]+)(\?.*)?$", f"$1._SX{width}_$2$3")
    return F.when(c.contains("media-amazon.com"), new).otherwise(F.coalesce(c, F.lit("")))


def reading_time(text: Column) -> Column:
    words = F.size(F.split(F.trim(text), r"\s+"))
    return F.concat(F.ceil(words / 200).cast("string"), F.lit(" min read"))


def refresh_hours(products: Column) -> Column:
    return F.when(products < 1000, 1).when(products < 5000, 6).when(products < 15000, 12).otherwise(24)
