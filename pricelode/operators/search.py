"""Prefix search with BM25 over an inverted index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import BucketTable

K1, B, SHORTEST, LONGEST = 1.2, 0.75, 2, 12


def tokens(text: Column) -> Column:
    """Distinct-keeping list of lower-case words of letters, digits and underscores."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda t: t != "")


def build_index(docs: DataFrame, text: list[str], key: str = "id") -> DataFrame:
    """token, doc, tf, length."""
    words = docs.select(F.col(key).alias("doc"), tokens(F.concat_ws(" ", *text)).alias("t"))
    return words.select("doc", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("token", "doc", "length").agg(F.count("*").alias("tf"))


def _asked(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token: the tokens that begin with each term. Terms are looked up among the beginnings of the
    distinct tokens, of which there are far fewer than postings."""
    grams = F.sequence(F.lit(SHORTEST), F.least(F.length("token"), F.lit(LONGEST)))
    edges = vocabulary.where(F.length("token") >= SHORTEST).select("token", F.explode(grams).alias("n")).withColumn("gram", F.col("token").substr(F.lit(1), F.col("n")))
    asked = terms.select("term").distinct().withColumn("gram", F.col("term").substr(1, LONGEST))
    return edges.join(asked, "gram").where(F.col("token").startswith(F.col("term"))).select("term", "token")


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).where(F.length("term") >= SHORTEST)


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc, score, place. queries: query_id, query. A document matches if for
    each term, of two letters or more, it has a token that begins with it.

    A term is looked up once for all queries that have it, and queries of the same terms are one.
    Only the documents of a query's rarest term are scored, so a word that most documents
    share costs a query no more than a rare one.
    """
    terms = _terms(queries)
    sizes = index.select("doc", "length").distinct().agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    return _ranked(index, _asked(terms, index.select("token").distinct()), terms, sizes, k)


def _ranked(postings: DataFrame, asked: DataFrame, terms: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The first k documents of each query. sizes: one row, the number of documents and their mean length.

    Queries of the same terms are answered once. A document's weights, one for each asked term that it has, are
    gathered into one row, so a candidate is scored where it is found: no pair of a query and a document is shuffled
    but the best k of each task.
    """
    # dealt by document once, for the terms' sums and the documents' weights
    found = postings.join(asked, "token").repartition("doc").groupBy("term", "doc", "length").agg(F.sum("tf").alias("tf"))
    size = sizes.select(F.struct("docs", "mean")).scalar()
    n_docs, mean = size["docs"], F.coalesce(F.nullif(size["mean"], F.lit(0.0)), F.lit(1.0))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    docs = found.select("doc", "term", weight.alias("weight")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
    known = docs.select(F.explode(F.map_keys("weights")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    queries = terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    wanted = queries.select("terms").distinct().select("terms", F.explode("terms").alias("term")).join(known.select("term", "df", idf.alias("idf")), "term")
    # lists of terms all of which are known, by their rarest term
    rarest = (
        wanted.groupBy("terms").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.collect_list(F.struct("term", "idf")).alias("idfs"))
        .where(F.size("idfs") == F.size("terms")).select("term", "terms", F.array_sort("idfs").alias("idfs"))
    )
    parts = F.transform("idfs", lambda x: x["idf"] * F.try_element_at("weights", x["term"]))
    # a term that the document lacks makes the sum null
    score = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    scored = docs.select("doc", "weights", F.explode(F.map_keys("weights")).alias("term")).join(rarest, "term").select("terms", "doc", score.alias("score")).where("score is not null")
    order = Window.partitionBy("terms").orderBy(F.round("score", 9).desc(), "doc")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return queries.join(best, "terms").select("query_id", "doc", "score", "place")


@dataclass(frozen=True)
class StoredIndex:
    """An index in files: postings in buckets by the first letters of their token, sorted by token,
    and the documents with their tokens. Documents that change write only their own postings."""

    path: str
    buckets: int = 64
    split: int = 4

    @property
    def postings(self) -> BucketTable:
        return BucketTable(f"{self.path}/postings", ("token", "doc"), (), self.buckets, by=f"substring(token, 1, {SHORTEST})", split=self.split, sort=("token",))

    @property
    def docs(self) -> BucketTable:
        return BucketTable(f"{self.path}/docs", ("doc",), (), self.buckets)

    def update(self, docs: DataFrame, text: list[str], key: str = "id", removed: DataFrame | None = None) -> None:
        """Puts documents in, in place of those of the same key, and takes out those that `removed` names.
        Postings that a document no longer has stay in the files with a frequency of 0 until
        their bucket is rewritten and are not read."""
        # texts are cut into tokens after they were dealt out: a small file of many texts is read by one task
        texts = docs.select(F.col(key).alias("doc"), F.concat_ws(" ", *text).alias("text")).dropDuplicates(["doc"])
        new = texts.select("doc", tokens(F.col("text")).alias("t"))
        gone = removed.select(F.col(key).alias("doc")).distinct() if removed is not None else new.select("doc").limit(0)
        postings = new.select("doc", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("token", "doc", "length").agg(F.count("*").cast("int").alias("tf"))
        if self.docs.exists(docs.sparkSession):
            touched = new.select("doc").union(gone).distinct()
            old = self.docs.read(docs.sparkSession, touched).join(touched, "doc", "left_semi").select("doc", F.explode("tokens").alias("token"))
            # a frequency of 0 for what a document had and has no longer
            stale = old.join(postings.select("token", "doc"), ["token", "doc"], "left_anti").select("token", "doc", F.lit(0).alias("length"), F.lit(0).alias("tf"))
            postings = postings.unionByName(stale)
        rows = new.select("doc", F.size("t").alias("length"), F.array_distinct("t").alias("tokens"))
        empty = gone.join(new, "doc", "left_anti").select("doc", F.lit(None).cast("int").alias("length"), F.array().cast("array<string>").alias("tokens"))
        # postings first: a writer that dies between the two leaves documents that an update puts right
        self.postings.append(postings)
        self.docs.append(rows.unionByName(empty))

    def read(self, spark: SparkSession, terms: DataFrame | None = None) -> DataFrame:
        """token, doc, length, tf; with `terms` (term) only from the buckets of their first letters."""
        return self.postings.read(spark, None if terms is None else self._named(terms)).where("tf > 0")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """What search() gives, from the files of the asked letters alone."""
        spark, terms = queries.sparkSession, _terms(queries)
        postings = self.read(spark, terms)
        # tokens that no document has any more are among them and find nothing; read after the postings, so none is missing
        vocabulary = self.postings.values(spark, ["token"], self._named(terms))
        sizes = self.docs.read(spark).where("length > 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
        return _ranked(postings, _asked(terms, vocabulary), terms, sizes, k)

    @staticmethod
    def _named(terms: DataFrame) -> DataFrame:
        return terms.select(F.col("term").alias("token"), F.lit(0).alias("doc"))


def contains_any_word(texts: DataFrame, words: DataFrame, key: str = "id", text: str = "title") -> DataFrame:
    """key, word: the texts that hold each word (words: word, in lower case) anywhere.

    Every word of three letters or more has its trigrams in any text that holds it: texts are looked up by the word's rarest
    one, and what is found is compared. A word of one or two letters is looked up by itself. The joins are by equal
    grams and titles only and are shuffled: titles, and above all their grams, are far larger than the file that
    they come from, so its size must not have them broadcast. Equal texts are looked through once. Empty words are found nowhere.
    """
    texts = texts.select(F.col(key), F.lower(text).alias("_low")).where("_low is not null")
    low = F.col("_low")
    asked = words.select("word").where("word <> ''").distinct().withColumn("size", F.least(F.length("word"), F.lit(3)))
    parts = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n))
    grams = asked.select("word", F.explode(F.array_distinct(parts(F.col("word"), F.col("size")))).alias("gram"))
    sizes = [F.when(F.length(low) >= n, parts(low, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
    held = texts.select(low).distinct().select(low, F.explode(F.array_distinct(F.concat(*sizes))).alias("gram"))
    # of each word the rarest gram, if all of them are somewhere
    counted = grams.join(held.groupBy("gram").agg(F.count("*").alias("n")).hint("merge"), "gram", "left")
    rarest = counted.groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("everywhere")).where("everywhere")
    found = held.join(rarest.select("word", "gram").hint("merge"), "gram").where(low.contains(F.col("word"))).select("_low", "word")
    return texts.join(found.hint("merge"), "_low").select(key, "word")


def search_like(docs: DataFrame, words: list[str], k: int, key: str = "id") -> DataFrame:
    """Documents whose title holds any of the words."""
    any_of = reduce(lambda a, b: a | b, [F.lower("title").contains(w.lower()) for w in words])
    return docs.where(any_of).orderBy(key).limit(k)
