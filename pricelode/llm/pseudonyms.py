"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses.

What a pattern finds is validated (Luhn for cards, mod 97 for IBANs, calendar for
dates, octets for IP addresses, numbering rules for phones and social security
numbers) and replaced by a keyed permutation of its own format: digits stay digits,
letters stay letters of their case, separators stay, and the result is valid again.
Equal values under one key so become equal pseudonyms in all documents, and different
ones stay different. What doesn't validate is left as it is.

The network: the characters are split into two halves; in each round every character
of one half is shifted, within its own alphabet, by a keyed SHA-256 of the other half.
Formats whose valid values are fewer than their strings walk the cycle: the network is
applied until the value is valid, which again is a permutation of the valid ones. All
of it is built-in SQL functions on the text's matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a cycle walk; a valid share of 0.6 leaves 1e-25 of values unfinished, which then get a pseudonym that doesn't validate.
WALK = 64
#: Dates are permuted within the days from 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS, DAY_SIDES = "1900-01-01", 73_049, (271, 270)

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
#: Characters of an IBAN, for countries that have letters in accounts; other countries' accounts are digits.
IBAN_LENGTHS = {
    18: "NL", 19: "MK", 20: "KZ LU", 21: "CH LI LV", 22: "BG BH GB GE IE", 23: "GI IQ OM", 24: "AD MD PK RO SA VG", 26: "TR", 27: "FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN LB NI SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])"
    for n, c in IBAN_LENGTHS.items()
)
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{2,6}}(?: ?[0-9]{{1,3}})?(?![A-Za-z0-9]))"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ \-]?(?:\([0-9]{1,4}\)[ \-]?)?[0-9]{2,4}(?:[ \-]?[0-9]{2,4}){1,3}(?![0-9])"
#: Digits in one run, or in the usual groups with one separator: further digits beside a card aren't part of it.
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<sep>[ \-])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}(?:\k<sep>[0-9]{3})?"
    r"|[0-9]{4}(?<gap>[ \-])[0-9]{6}\k<gap>[0-9]{4,5})(?![0-9])"
)
# Country calling codes of one and two digits; all others have three. No code begins another.
CALLING_1 = ["1", "7"]
CALLING_2 = [
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
]
ANY = "|".join((EMAIL, DATE, IP, IBAN, SSN, PHONE, CARD))


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, 1))


def _start(c: Column) -> Column:
    """The first code of a character's alphabet; null for what stays."""
    return (
        F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
    )


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1)


def _shift(key: Column, kind: str, r: Column, other: Column, i: Column) -> Column:
    seen = F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)
    return F.conv(F.substring(seen, (i * 4 % 60 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _network(key: Column, kind: str, left: Column, right: Column, left_radix: Callable, right_radix: Callable) -> Column:
    """struct(a, b) of the two halves (arrays of numbers) after all rounds."""
    turn = lambda own, other, radix, r: F.transform(own, lambda x, i: (x + _shift(key, kind, r, other, i)) % radix(i))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(left.alias("a"), right.alias("b")),
        lambda s, r: F.when(r % 2 == 0, F.struct(turn(s["a"], s["b"], left_radix, r).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), turn(s["b"], s["a"], right_radix, r).alias("b"))
        ),
    )


def permuted(text: Column, key: Column, kind: str) -> Column:
    """A permutation of the strings with the same alphabet at each place."""
    chars = _chars(text)
    values = F.transform(chars, lambda c: F.coalesce(F.ascii(c) - _start(c), F.lit(0)))
    radix = F.transform(chars, _radix)
    half = F.floor(F.length(text) / 2).cast("int")
    out = _network(
        key, kind, F.slice(values, F.lit(1), half), F.slice(values, half + 1, F.length(text) - half),
        lambda i: F.get(radix, i), lambda i: F.get(radix, i + half),
    )
    return F.array_join(
        F.zip_with(chars, F.concat(out["a"], out["b"]), lambda c, v: F.coalesce(F.chr((_start(c) + v).cast("int")), c)), ""
    )


def _walked(start: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """step() over and over until valid(); what WALK steps lead to if they don't do, never `start` itself."""
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.struct(start.alias("v"), F.lit(False).alias("done")),
        lambda s, _: F.when(s["done"], s).otherwise(_stepped(step(s["v"]), valid)),
    )
    return end["v"]


def _stepped(v: Column, valid: Callable[[Column], Column]) -> Column:
    # one-element transform: the new value is computed once
    return F.get(F.transform(F.array(v), lambda x: F.struct(x.alias("v"), F.coalesce(valid(x), F.lit(False)).alias("done"))), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _signs(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Z0-9]", "")


def _refilled(form: Column, signs: Column) -> Column:
    """`form` with its digits and capitals replaced by `signs` in turn: separators have no say in a pseudonym."""
    sign = lambda c: c.between("0", "9") | c.between("A", "Z")
    return F.array_join(
        F.transform(_chars(form), lambda c, i: F.when(sign(c), signs.substr(F.length(_signs(form.substr(F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""
    )


def luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    terms = F.transform(
        F.reverse(_chars(digits)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10


def _card(m: Column, key: Column) -> Column:
    digits = _digits(m)
    head = permuted(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
    checked = lambda h: F.concat(h, ((10 - luhn(F.concat(h, F.lit("0")))) % 10).cast("string"))
    return _refilled(m, F.get(F.transform(F.array(head), checked), F.lit(0)))


def _mod97(country: Column, check: Column, account: Column) -> Column:
    # letters count as 10 to 35; the remainder is taken sign by sign
    return F.aggregate(
        _chars(F.concat(account, country, check)), F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97,
    )


def _iban(m: Column, key: Column) -> Column:
    country, rest = F.substring(m, 1, 2), m.substr(F.lit(5), F.length(m))
    checked = lambda d: F.concat(F.lpad((98 - _mod97(country, F.lit("00"), d)).cast("string"), 2, "0"), _refilled(rest, d))
    return F.concat(country, F.get(F.transform(F.array(permuted(_signs(rest), key, "iban")), checked), F.lit(0)))


def _ip(m: Column, key: Column) -> Column:
    part = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    word = lambda i: F.array(F.get(part, F.lit(i)) * 256 + F.get(part, F.lit(i + 1)))
    out = _network(key, "ip", word(0), word(2), lambda i: F.lit(65536), lambda i: F.lit(65536))
    a, b = F.get(out["a"], F.lit(0)), F.get(out["b"], F.lit(0))
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(a / 256), a % 256, F.floor(b / 256), b % 256)])


def _date(m: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(F.when(m.contains("-"), m), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.when(m.contains("."), m), F.lit("dd.MM.yyyy")),
        F.try_to_timestamp(F.when(m.contains("/"), m), F.lit("MM/dd/yyyy")),
    ).cast("date")


def _day(m: Column) -> Column:
    return F.datediff(_date(m), F.lit(FIRST_DAY).cast("date"))


def _new_date(m: Column, key: Column) -> Column:
    a, b = DAY_SIDES

    def step(n: Column) -> Column:
        out = _network(key, "date", F.array(F.floor(n / b).cast("int")), F.array((n % b).cast("int")), lambda i: F.lit(a), lambda i: F.lit(b))
        return (F.get(out["a"], F.lit(0)) * b + F.get(out["b"], F.lit(0))).cast("int")

    day = F.date_add(F.lit(FIRST_DAY).cast("date"), _walked(_day(m), step, lambda n: n < DAYS))
    return F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(m.contains("."), F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))


def _us(m: Column) -> Column:
    return m.rlike(r"^\+1[ \-]?\(?[2-9][0-9]{2}\)?[ \-]?[2-9][0-9]{2}[ \-]?[0-9]{4}$")


def _phone(m: Column, key: Column) -> Column:
    # by the code table, not by separators: one number has one pseudonym however it is written
    first, all_digits = lambda n: F.substring(all_digits, 1, n), _digits(m)
    size = F.when(first(1).isin(CALLING_1), 1).when(first(2).isin(CALLING_2), 2).otherwise(3)
    code = F.regexp_extract(m, r"^\+(?:[^0-9]*[0-9]){3}", 0)
    code = F.when(size == 1, F.regexp_extract(m, r"^\+[^0-9]*[0-9]", 0)).when(size == 2, F.regexp_extract(m, r"^\+(?:[^0-9]*[0-9]){2}", 0)).otherwise(code)
    digits = all_digits.substr(size + 1, F.length(all_digits))
    step = lambda x: permuted(x, key, "phone")
    new = F.when(_us(m), _walked(digits, step, lambda x: x.rlike("^[2-9][0-9]{2}[2-9]"))).otherwise(step(digits))
    return F.concat(code, F.get(F.transform(F.array(new), lambda d: _refilled(m.substr(F.length(code) + 1, F.length(m)), d)), F.lit(0)))


def _is_ssn(m: Column) -> Column:
    return m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one match; null if it doesn't validate."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    local = F.substring_index(m, "@", 1)
    return (
        F.when(m.contains("@"), F.concat(permuted(local, key, "mail"), m.substr(F.length(local) + 1, F.length(m))))
        .when(whole(DATE), F.when(_day(m).between(0, DAYS - 1), _new_date(m, key)))
        .when(whole(IP), F.when(~F.exists(F.split(m, "\\."), lambda x: x.cast("int") > 255), _ip(m, key)))
        .when(whole(IBAN), F.when(_mod97(F.substring(m, 1, 2), F.substring(m, 3, 2), _signs(m.substr(F.lit(5), F.length(m)))) == 1, _iban(m, key)))
        .when(whole(SSN), F.when(_is_ssn(m), _walked(m, lambda x: permuted(x, key, "ssn"), _is_ssn)))
        .when(m.startswith("+"), _phone(m, key))
        .when(luhn(_digits(m)) == 0, _card(m, key))
        # four groups of four are a card, three digits behind it its security code
        .when(m.rlike("[ -][0-9]{3}$") & (luhn(_digits(F.substring(m, 1, 19))) == 0), F.concat(_card(F.substring(m, 1, 19), key), F.substring(m, 20, 4)))
    )


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """`rows` (text, ...) with the key in a column `key`. It comes from a table of one row, so that it
    stands in no plan, no web page and no event log, as a literal would. The join is by
    a length that is never -1, which Spark doesn't see through, and is a broadcast."""
    one = rows.sparkSession.createDataFrame([(0, key)], "zero int, key string")
    zero = F.when(F.length("text") < 0, 1).otherwise(0)
    return rows.withColumn("zero", zero).join(F.broadcast(one), "zero").drop("zero")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with `text` rewritten and `n_replaced`, the number of values replaced.

    Null and empty texts stay, with 0. Texts of any length are handled whole, match by
    match. All other columns stay; a column n_replaced of the input is replaced.
    Repeated rows give equal rows, an empty table no rows.
    """
    if not key:
        raise ValueError("a key is needed")
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    between = F.split("text", ANY, -1)
    new = F.transform("found", lambda m: F.struct(m.alias("old"), pseudonym(m, F.col("key")).alias("new")))
    text = F.concat(
        F.get("between", F.lit(0)),
        F.array_join(F.zip_with("new", F.slice("between", F.lit(2), F.size("new")), lambda x, s: F.concat(F.coalesce(x["new"], x["old"]), s)), ""),
    )
    kept = [c for c in docs.columns if c.lower() != "n_replaced"]
    # other columns travel in a struct, so that none of them, whatever its name is, meets one of this function's
    others = [F.col(f"`{c}`") for c in kept if c.lower() != "text"]
    out = (
        _keyed(docs.select("text", (F.struct(*others) if others else F.lit(0)).alias("others")), key).withColumn("found", found)
        .withColumn("new", F.when(F.size("found") > 0, new))
        .withColumn("between", F.when(F.size("found") > 0, between))
        .withColumn("text", F.when(F.col("new").isNotNull(), text).otherwise(F.col("text")))
        .withColumn("n_replaced", F.coalesce(F.size(F.filter("new", lambda x: x["new"].isNotNull())), F.lit(0)).cast("long"))
    )
    return out.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col("others")[c].alias(c) for c in kept], "n_replaced")
