"""MinHash near-duplicates with tensored banding.

A table key needs several minhashes that all agree. Instead of new minhashes for each
table, two collections of SIDE short bands are computed, and every pair of one band
from each makes a table: SIDE * SIDE tables from 2 * SIDE * ROWS minhashes. Documents
that share a key are candidates; links are confirmed on the full shingle sets.

Bound of what is missed: with s the similarity, a pair at s meets in no table with
probability 1 - (1 - (1 - s^ROWS)^SIDE)^2, which is 0.3 % at 0.8 and 0.04 % at 0.85.

Exact copies (equal shingle sets) become one class first, so they cost nothing more.
In a bucket every class is compared with one representative; where that leaves it in
several components, one class of each, drawn at random, is compared with one of the largest, TURNS times. Where it still
is, the classes that hang together by such buckets are dealt into blocks, and each pair of blocks is one group that compares its sets at once and
returns no more links than it takes to connect them. No pair of classes is a row, no
group holds more than two blocks, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .graph import connected_components

SIDE, ROWS = 9, 3
#: How often components of a bucket are compared by one class of each.
TURNS = 2
#: So many shingles are hashed at once, and so many words remembered by a task.
BATCH, MEMO = 200_000, 400_000
#: A block of a torn group holds about so many classes, or fewer if they have more than so many shingles.
BLOCK, BLOCK_SHINGLES = 400, 400_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Words (runs of anything but ASCII blanks) with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, memo: dict) -> np.ndarray:
    """The distinct k-word shingles as sorted 64-bit hashes; fewer than k words are
    one shingle, no words an empty set. That two of n shingles of a pair of documents
    clash has a chance of n^2 / 2^65, below 1e-10 for texts of 50,000 words."""
    if len(memo) > MEMO:
        memo.clear()
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    width = min(k, len(h))
    n = len(h) - width + 1
    s = np.full(n, np.uint64(width))
    for i in range(width):
        s = s * _ODD + h[i : i + n]
    return np.unique(_mixed(s))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    draw = lambda: rng.integers(0, 2**64, n, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """For each (not empty) set its 2 * SIDE bands, each a hash of ROWS minhashes."""
    a, b = _coefficients(2 * SIDE * ROWS)
    x = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[:-1]]))).astype(np.int64)
    out = np.zeros((len(sets), 2 * SIDE), np.uint64)
    for j in range(2 * SIDE):
        for r in range(ROWS):
            i = j * ROWS + r
            out[:, j] = out[:, j] * _ODD + _mixed(np.minimum.reduceat(x * a[i] + b[i], starts))
    return out


_SIGNED = "doc_id long, digest string, n long, bands array<long>"
_SETS = "doc_id long, digest string, hashes array<long>"


def _longs(rows: np.ndarray | list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if len(rows) and ends[-1] else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _digest(s: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None


def _signer(k: int, sets_too: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()

        def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            head = [pa.array(ids, pa.int64()), pa.array([_digest(s) for s in sets], pa.string())]
            if sets_too:
                return pa.RecordBatch.from_arrays([*head, _longs(sets)], ["doc_id", "digest", "hashes"])
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = dict(zip(full, bands([sets[i] for i in full]), strict=True)) if full else {}
            empty = np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays(
                [*head, pa.array([len(s) for s in sets], pa.int64()), _longs([keys.get(i, empty) for i in range(len(sets))])],
                ["doc_id", "digest", "n", "bands"],
            )

        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                sets.append(shingle_set(text.as_py(), k, memo))
                held += len(sets[-1])
                if held > BATCH:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield flush(ids, sets)

    return run


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, hashes: the full shingle set of each class of `nodes`."""
    wanted = classes.join(nodes.select("node"), "node", "left_semi").select("node", F.col("digest").alias("wanted"), "least")
    ids = wanted.select("least").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (
        docs.join(ids, docs["doc_id"].eqNullSafe(ids["least"]), "left_semi")
        .mapInArrow(_signer(k, True), _SETS).where("digest is not null")
        .join(wanted, F.col("digest") == F.col("wanted")).where(F.col("doc_id").eqNullSafe(F.col("least")))
        .groupBy("node").agg(F.first("hashes").alias("hashes"))
    )


def _linked(group: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar enough among the sets of a group and is not
    yet in one component."""
    group = group.drop_duplicates("node")
    sets = [np.asarray(x) for x in group["hashes"]]
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.flatnonzero(np.bincount(column, minlength=len(values)) > 1)
    both = np.zeros((len(sets), len(sets)), np.float32)
    rank = np.full(len(values), -1)
    rank[shared] = np.arange(len(shared))
    column = rank[column]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    i, j = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
    node, part = group["node"].tolist(), group["component"].tolist()
    root = {c: c for c in part}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(part[x]), top(part[y])
        if a != b:
            root[a] = b
            out.append((node[x], node[y]))
    return out


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (u, v) whose sets are similar enough."""
    rows = (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    )
    both = F.size(F.array_intersect("a", "b"))
    return rows.where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def _torn(rows: DataFrame) -> DataFrame:
    """Of the buckets that lie in several components one row for each of these: key, component, n (classes),
    heads (drawn at random, one a turn), main (component, heads of the largest one). rows: key, component, n, heads."""
    drawn = lambda i: F.min_by(F.get("heads", F.lit(i)), F.xxhash64(F.lit(i), F.get("heads", F.lit(i))))
    parts = rows.groupBy("key", "component").agg(F.sum("n").alias("n"), F.array(*[drawn(i) for i in range(TURNS)]).alias("heads"))
    main = F.max_by(F.struct("component", "heads"), F.struct("n", "component")).alias("main")
    # buckets of two are settled by the comparison with the head
    keys = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), main).where("parts > 1 and size > 2")
    return cut(parts.join(small(cut(keys.select("key", "main")), 32 + 16 * TURNS), "key"))


def _mended(torn: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the components of torn buckets. torn: node, n, component, head."""
    group = connected_components(torn.select(F.col("node").alias("u"), F.col("head").alias("v"))).withColumnRenamed("component", "torn")
    nodes = cut(torn.select("node", "n", "component").distinct().join(group, "node"))
    sizes = cut(nodes.groupBy("torn").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        nodes.join(small(sizes, 24), "torn").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("torn", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "component")
    )
    find = lambda g: pd.DataFrame(_linked(g, percent), columns=["u", "v"])
    return dealt.join(sets, "node").groupBy("torn", "p", "q").applyInPandas(find, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept
    (doc_id = component_id) for each row of `docs` (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their sets of
    distinct k-word shingles; with fewer words the whole sequence is one shingle; no
    words (null, empty or blank text) link with nothing. Rows with the same doc_id and
    some words are one vertex, which has the links of all their texts. A row without doc_id belongs to the component of its text, has no say
    in its name, and is kept if no row with a doc_id shares it. Repeated rows all get
    the same result. Other columns are not looked at. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    signed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signer(k, False), _SIGNED))
    classes = cut(
        signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    tables = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("t")
    side = lambda i: F.get("bands", i)
    keys = classes.select("node", "bands", tables).select(
        F.xxhash64("t", side(F.floor(F.col("t") / SIDE).cast("int")), side(F.lit(SIDE) + F.col("t") % SIDE)).alias("key"), "node"
    )
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = cut(keys.join(heads.select("key", "head"), "key"))
    sizes = cut(members.select("node").distinct().join(classes.select("node", "n"), "node"))
    sets = cut(_sets(docs, classes, sizes, k))

    star = members.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    links = cut(_near(star, sets, percent).union(_same_ids(signed, classes)))
    part = cut(connected_components(links))
    component = F.coalesce("component", "node").alias("component")
    torn = _torn(members.join(part, "node", "left").select("key", component, F.lit(1).alias("n"), F.array_repeat("node", TURNS).alias("heads")))
    for turn in range(TURNS):
        if torn.isEmpty():
            break
        u, v = F.get("heads", F.lit(turn)), F.get("main.heads", F.lit(turn))
        pairs = torn.where("component <> main.component").select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
        links = cut(links.union(_near(pairs, sets, percent)))
        part = cut(connected_components(links))
        # a component only grows as a whole: one of its classes tells where all are now
        heads = torn.select("key", "n", "heads", F.get("heads", F.lit(0)).alias("node"))
        torn = _torn(heads.join(part, "node", "left").select("key", component, "n", "heads"))
    if not torn.isEmpty():
        keys = small(cut(torn.select("key").distinct()), 16)
        placed = cut(members.join(keys, "key", "left_semi").join(part, "node", "left").join(sizes, "node").select("node", "n", component, "head"))
        part = cut(connected_components(links.union(_mended(placed, sets, percent))))

    # components are called by their smallest id
    names = cut(part.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("name")))
    called = part.join(small(names, 24), "component").select("node", "name")
    named = classes.select("digest", "node", "least").join(called, "node", "left").select("digest", F.coalesce("name", "least").alias("component"))
    return (
        signed.join(named, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def _same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of rows that share an id but not their words."""
    rows = signed.where("n > 0 and doc_id is not null").select("doc_id", "digest")
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last")
    pairs = rows.join(small(cut(several.select("doc_id", "first")), 80), "doc_id").where("digest <> first").distinct()
    u, v = (classes.select(F.col("digest").alias(d), F.col("node").alias(n)) for d, n in (("digest", "u"), ("first", "v")))
    return pairs.join(u, "digest").join(v, "first").select("u", "v")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs`, all columns, with one row of each component of near_duplicates().

    It is the one with the smallest doc_id; of rows that share it one stays for each
    text. A row without a doc_id can't be named, and stays.
    """
    found = cut(near_duplicates(docs, k, percent).where("doc_id is not null").select("doc_id", "kept"))
    gone = cut(found.where("not kept").select("doc_id").distinct())
    twice = cut(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = docs.join(small(gone, 16), "doc_id", "left_anti")
    if twice.isEmpty():
        return left.select(docs.columns)
    again = left.join(small(twice, 16), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(small(twice, 16), "doc_id", "left_anti").select(docs.columns).union(again.select(docs.columns))
