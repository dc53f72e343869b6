"""Line deduplication by deletion neighbourhoods.

Lines are sequences of lower-case words. Equal lines are found by their hashes. Lines
are also near if one word inserted, deleted or replaced turns one into the other and is
at most a SHARE-th of the shorter one's words (so lines of one to three words are only
near if they are equal: another word makes them another line). Each line emits the hashes
of itself and of all variants with one word deleted, equal hashes meet, and the words are
compared. Of all lines that hang together the earliest, by doc_id and place, stays.

One edit leaves either the first or the last half of a line as it was; so only lines
that share the hash of such a half with another line emit variants at all. A variant's
hash is a sum over its words and places, so all variants of a line cost one pass of
running sums. Lines that meet in a variant link to one of them, never to each other in
pairs. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, small
from .graph import connected_components

#: The one edit may be so large a part of a line: one word of four.
SHARE = 4

_DOC = ["doc_id", "doc_hash"]


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[\x20\x09-\x0D]+"), "")


def _halves(w: Column) -> Column:
    """Hashes of the first and last n/2 and (n-1)/2 words: what two lines whose lengths
    differ by one at most, and with one edit between them, share."""
    n = F.size(w)
    parts = []
    # with a line as long or longer by one, and with one shorter by one if that may be near at all
    for length in (F.floor(n / 2).cast("int"), F.floor((n - (n > SHARE).cast("int")) / 2).cast("int")):
        parts += [F.xxhash64(F.lit(1), length, F.slice(w, F.lit(1), length)), F.xxhash64(F.lit(2), length, F.slice(w, n - length + 1, length))]
    return F.array_distinct(F.array(*parts))


def _near_links(lines: DataFrame) -> DataFrame:
    """Links (u, v) between lines (line: long, w: words) one edit apart: for each
    variant that several lines have, each of them to one."""
    code = lambda shift: F.shiftrightunsigned(F.xxhash64(F.col("word"), F.col("i") - shift), 24)
    every = Window.partitionBy("line")
    before = every.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = every.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = (
        # whole lines are dealt out, their words stay where they are
        lines.repartition("line").select("line", F.posexplode("w").alias("i", "word")).withColumn("at", code(0)).withColumn("moved", code(1))
        .select(
            "line", "i", F.count("*").over(every).alias("n"), F.sum("at").over(every).alias("own"),
            (F.coalesce(F.sum("at").over(before), F.lit(0)) + F.sum("moved").over(every) - F.sum("moved").over(upto)).alias("less"),
        )
    )
    rows = cut(
        places.select(
            "line",
            F.explode(
                F.array(
                    # the same place deleted in both: one word replaced
                    F.struct(F.xxhash64(F.lit("r"), "n", "i", "less").alias("key"), F.col("i").alias("i"), F.lit(False).alias("whole")),
                    # deleted in one and whole in the other: one word more
                    F.struct(F.xxhash64(F.lit("d"), F.col("n") - 1, "less").alias("key"), F.col("i").alias("i"), F.lit(False).alias("whole")),
                    F.when(F.col("i") == 0, F.struct(F.xxhash64(F.lit("d"), "n", "own").alias("key"), F.lit(-1).alias("i"), F.lit(True).alias("whole"))),
                )
            ).alias("x"),
        ).where("x is not null").select("line", "x.*")
    )
    heads = cut(
        rows.groupBy("key")
        .agg(F.min("line").alias("a"), F.max("line").alias("b"), F.min(F.when(F.col("whole"), F.col("line"))).alias("whole_line"))
        .where("a <> b").select("key", F.coalesce("whole_line", "a").alias("head"))
    )
    pairs = rows.join(small(heads, 32), "key").where("line <> head and not whole").select("line", "head", "i").distinct()
    a, b = lines.select(F.col("line"), F.col("w").alias("x")), lines.select(F.col("line").alias("head"), F.col("w").alias("y"))
    enough = F.least(F.size("x"), F.size("y")) >= SHARE
    less = lambda w: F.concat(F.slice(w, F.lit(1), F.col("i")), F.slice(w, F.col("i") + 2, F.greatest(F.size(w) - F.col("i") - 1, F.lit(0))))
    near = F.when(F.size("x") == F.size("y"), less("x") == less("y")).otherwise(less("x") == F.col("y"))
    return pairs.join(a, "line").join(b, "head").where(enough & near).select(F.col("line").alias("u"), F.col("head").alias("v"))


def _small_lists(rows: DataFrame, column: str, bytes_each: int) -> DataFrame:
    """One row a document with a list of places: broadcast if the sizes, summed, show
    that it is small, so that no text is shuffled; else Spark shuffles."""
    rows = cut(rows)
    n, each = rows.agg(F.count("*"), F.sum(F.size(column))).first()
    return F.broadcast(rows) if n * 64 + (each or 0) * bytes_each <= BROADCAST_BYTES else rows


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """`docs` with `text` without its repeated lines, and n_lines, n_removed.

    Lines are what stands between line feeds. A line goes if an earlier one, in the
    order of doc_id (nulls first) and place, is equal to it or hangs together with it
    by single edits (see the module's head). Blank lines stay. Null and empty texts stay and have n_removed 0.
    Rows equal in id and text are one document and all get its result. All other
    columns stay; n_lines and n_removed of the input are replaced. An empty table gives
    no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = docs.select(*kept)
    named = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), "text").where("text is not null")
    w = F.col("w")
    place = F.struct("doc_id", "doc_hash", "at").alias("place")
    lines = cut(
        named.select(*_DOC, F.posexplode(F.split("text", "\n")).alias("at", "line"))
        # one-element explode: the words are split once for all that is made of them
        .select(*_DOC, "at", F.explode(F.array(_words(F.col("line")))).alias("w")).where(F.size(w) > 0)
        .select(
            place, F.xxhash64(w).alias("h"), F.xxhash64(F.lit(3), w).alias("h2"),
            F.when(F.size(w) >= SHARE, _halves(w)).alias("halves"),
        )
    )
    distinct = cut(lines.groupBy("h", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n")))

    halves = lines.select("h", F.explode("halves").alias("half"))
    shared = cut(halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half"))
    alike = cut(halves.join(small(shared, 16), "half", "left_semi").select("h").distinct())
    wanted = (
        distinct.join(small(alike, 16), "h", "left_semi").groupBy("place.doc_id", "place.doc_hash")
        .agg(F.collect_list(F.struct("place.at", "h")).alias("wanted"))
    )
    near = cut(
        named.alias("d").join(_small_lists(wanted, "wanted", 24).alias("t"), (F.col("t.doc_hash") == F.col("d.doc_hash")) & F.col("t.doc_id").eqNullSafe(F.col("d.doc_id")))
        .select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("x"))
        .select(F.col("x.h").alias("line"), _words(F.get("all", F.col("x.at"))).alias("w"))
        .dropDuplicates(["line"])
    )
    part = cut(connected_components(_near_links(near)).withColumnRenamed("node", "h"))
    grouped = distinct.join(small(part, 16), "h", "left")
    first = cut(grouped.where("component is not null").groupBy("component").agg(F.min("place").alias("first")))
    keepers = grouped.join(small(first, 48), "component", "left").select("h", "h2", "n", "place", F.coalesce("first", "place").alias("first"))
    keepers = cut(keepers.where((F.col("n") > 1) | (F.col("place") != F.col("first"))).select("h", "h2", "first"))
    gone = (
        lines.select("h", "h2", "place").join(small(keepers, 64), ["h", "h2"]).where(F.col("place") != F.col("first"))
        .groupBy("place.doc_id", "place.doc_hash").agg(F.array_sort(F.collect_set("place.at")).alias("gone"))
    )
    g = gone.alias("g")
    # other columns travel in a struct, so that none of them, whatever its name is, meets one of this function's
    others = [F.col(f"`{c}`") for c in kept if c.lower() not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), (F.struct(*others) if others else F.lit(0)).alias("others")).alias("d")
    # the runs of lines between those that go; the one-element transform splits the text once
    before, after = F.concat(F.array(F.lit(-1)), F.col("gone")), lambda n: F.concat(F.col("gone"), F.array(n))
    runs = lambda all_lines: F.zip_with(before, after(F.size(all_lines)), lambda a, b: F.slice(all_lines, a + 2, b - a - 1))
    left = F.flatten(F.get(F.transform(F.array(F.split("text", "\n")), runs), F.lit(0)))
    out = (
        rows.join(g, (F.col("d.hash") == F.col("g.doc_hash")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
        .select("d.doc_id", "d.text", "d.others", "g.gone")
        .withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
        .withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    )
    return out.select(*[F.col(c.lower()).alias(c) if c.lower() in ("doc_id", "text") else F.col("others")[c].alias(c) for c in kept], "n_lines", "n_removed")
