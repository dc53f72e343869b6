"""Hard negatives by exact integer inner products, scored the Four-Russians way.

Components are whole numbers, kept as bit planes: a vector's dimensions are taken in
groups of eight, and for each bit of the components' two's complement the eight bits of
a group are one byte. For an anchor, a table of each group holds the sums of all 256
subsets of its eight components. A candidate's byte in a plane is then the index of the
sum that this plane adds to the inner product, up to a shift by the plane's weight; the
top plane, of the signs, is taken off. Sums of whole numbers are exact.

Anchors are a stated share of the rows, so all pairs of anchor and candidate are scored,
in tiles: anchors and candidates are dealt evenly into blocks, and a task scores one block
against another. Only the first few of each tile leave it. The first pass pairs rows of the
same label only and finds the positives, the second one finds the negatives between the
limits that the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

GROUP = 8
#: Candidates of a block are at most BLOCK; fewer, down to SMALLEST, as long as that makes no more than SPREAD blocks.
BLOCK, SMALLEST, SPREAD = 16384, 512, 32
#: Anchors whose tables are held at once.
TABLES = 128
#: Whole numbers beyond this are refused, so that no sum leaves 64 bits.
LARGEST = 1 << 24


def packed(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit planes of whole numbers (rows x dimensions): rows x planes x groups bytes, and the number of planes."""
    n, dim = x.shape
    top = int(max(x.max(initial=0), -1 - x.min(initial=0)))
    planes = top.bit_length() + 1
    padded = np.zeros((n, -(-dim // GROUP) * GROUP), np.int64)
    padded[:, :dim] = x
    bits = np.stack([(padded >> b) & 1 for b in range(planes)], 1).astype(np.uint8)
    return np.packbits(bits.reshape(n, planes, -1, GROUP), axis=3, bitorder="little")[..., 0], planes


def unpacked(planes: np.ndarray, dim: int) -> np.ndarray:
    bits = np.unpackbits(planes[..., None], axis=3, bitorder="little").reshape(*planes.shape[:2], -1)[:, :, :dim].astype(np.int64)
    return np.einsum("npd,p->nd", bits, weights(planes.shape[1]))


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane counts for: powers of two, the top one negative."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def aligned(raw: list[bytes], groups: int) -> np.ndarray:
    """Packed rows, each brought to the largest number of planes by repeating its plane of signs."""
    n_planes = np.array([len(b) // groups if groups else 1 for b in raw])
    out = np.empty((len(raw), int(n_planes.max(initial=1)), groups), np.uint8)
    for p in np.unique(n_planes).tolist():
        at = np.flatnonzero(n_planes == p)
        own = np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint8).reshape(len(at), p, groups)
        out[at, :p] = own
        out[at, p:] = own[:, -1:]
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: sums of the components that the bits of a byte name."""
    n, dim = anchors.shape
    groups = -(-dim // GROUP)
    x = np.zeros((n, groups * GROUP), np.int64)
    x[:, :dim] = anchors
    x = x.reshape(n, groups, GROUP).transpose(1, 2, 0)
    table = np.zeros((groups, 1 << GROUP, n), np.int64)
    for j in range(GROUP):
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + x[:, j : j + 1]
    return table


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """candidates x anchors: exact inner products."""
    table = subset_sums(anchors)
    out = np.zeros((len(planes), len(anchors)), np.int64)
    # a plane's sum stays below the sum of all absolute values: mostly 32 bits hold it
    kind = np.int32 if np.abs(anchors).sum(1).max(initial=0) < 1 << 31 else np.int64
    table, part = table.astype(kind), np.empty(out.shape, kind)
    for p, w in enumerate(weights(planes.shape[1]).tolist()):
        part[:] = 0
        for g in range(planes.shape[2]):
            part += table[g][planes[:, p, g]]
        out += part.astype(np.int64) * w
    return out


def _tile(table: pa.Table):
    """Anchors and candidates of a tile: (rows, columns by name), candidates by id; and scores for runs of anchors."""
    table = table.sort_by([("is_anchor", "descending"), ("id", "ascending")])
    n_anchors = int(np.count_nonzero(table.column("is_anchor").to_numpy()))
    a, c = table.slice(0, n_anchors), table.slice(n_anchors)
    dim = table.column("dim")[0].as_py()
    groups = -(-dim // GROUP)
    numbers = unpacked(aligned(a.column("planes").to_pylist(), groups), dim)
    planes = aligned(c.column("planes").to_pylist(), groups)

    def runs():
        for lo in range(0, len(a), TABLES):
            yield lo, scores(numbers[lo : lo + TABLES], planes)

    return a, c, runs


_POSITIVE = "anchor_id long, score long, id long"


def _positives(k: int):
    def first(table: pa.Table) -> pa.Table:
        a, c, runs = _tile(table)
        anchor_ids, ids = a.column("id").to_numpy(), c.column("id").to_numpy()
        out = [[], [], []]
        for lo, s in runs():
            for j in range(s.shape[1]):
                own = anchor_ids[lo + j]
                at = np.flatnonzero(ids != own)
                at = at[_largest(s[at, j], k)]
                for col, v in zip(out, (np.full(len(at), own), s[at, j], ids[at]), strict=True):
                    col.append(v)
        cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table(cols, ["anchor_id", "score", "id"])

    return first


def _largest(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties by place."""
    if len(s) > 4 * k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        near = np.flatnonzero(s >= least)
    else:
        near = np.arange(len(s))
    return near[np.argsort(-s[near], kind="stable")[:k]]


_NEGATIVE = "anchor_id long, positive_id long, positive_score long, score long, id long"


def _negatives(k: int, low: int, high: int):
    def first(table: pa.Table) -> pa.Table:
        a, c, runs = _tile(table)
        anchor_ids, labels, positives = a.column("id").to_numpy(), a.column("label").to_numpy(), a.column("positives").to_pylist()
        ids, other = c.column("id").to_numpy(), c.column("label").to_numpy()
        out = [[], [], [], [], []]
        for lo, s in runs():
            for j in range(s.shape[1]):
                mine = positives[lo + j]
                most = max(p["score"] for p in mine)
                x = s[:, j]
                at = np.flatnonzero((other != labels[lo + j]) & (100 * x <= high * most))
                at = at[np.argsort(-x[at], kind="stable")]
                falling = -100 * x[at]
                for p in mine:
                    # the first not above `high` per cent, as long as it isn't below `low`
                    begin = np.searchsorted(falling, -high * p["score"], "left")
                    end = np.searchsorted(falling, -low * p["score"], "right")
                    got = at[begin : min(end, begin + k)]
                    for col, v in zip(out, (np.full(len(got), anchor_ids[lo + j]), np.full(len(got), p["id"]), np.full(len(got), p["score"]), x[got], ids[got]), strict=True):
                        col.append(v)
        cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table(cols, ["anchor_id", "positive_id", "positive_score", "score", "id"])

    return first


def _blocks(n: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.least(F.ceil(n / SMALLEST), F.lit(SPREAD))).cast("int")


def _tiles(anchors: DataFrame, candidates: DataFrame, within: list[str]) -> DataFrame:
    """Rows of both kinds in tiles: `within`, a (block of anchors), c (block of candidates).
    Groups of `within` are dealt into blocks by their counts, so a large one meets in many tasks."""
    sizes = (
        candidates.groupBy(*within).agg(F.count("*").alias("n")).join(anchors.groupBy(*within).agg(F.count("*").alias("m")), within)
        .select(*within, _blocks(F.col("n")).alias("_c"), F.ceil(F.col("m") / BLOCK).cast("int").alias("_a"))
    )
    a, c = anchors.join(sizes, within), candidates.join(sizes, within)
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    cols = ["dim", "id", "label", "planes", "positives", "a", "c", "is_anchor"]
    none = F.lit(None).cast(anchors.schema["positives"].dataType)
    a = a.withColumns({"a": own("_a"), "is_anchor": F.lit(1)}).withColumn("c", every("_c")).select(*cols)
    c = c.withColumns({"c": own("_c"), "is_anchor": F.lit(0), "positives": none}).withColumn("a", every("_a")).select(*cols)
    return a.union(c)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_column: str = "vec_id", column: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); a row's score is its inner product with the
    anchor, larger ones first, ties by the smaller id. Anchors are the rows where
    `is_anchor`, a column over `vectors`, holds. An anchor's positives are the first
    `n_positives` other rows of its label. For each of them the first `n_negatives` rows
    of other labels are returned whose score is from `low` to `high` per cent of the
    positive's, both included; all, if there are fewer. A score of a positive below 0 has no
    such rows; one of 0 has those of 0.

    Rows without an id, a label or a vector, or with a null or non-finite component, take
    no part. Of several rows of one id the one of the smallest label, then of the smallest
    vector counts. Rows meet rows of the same number of components only. Components
    beyond 2**24 after scaling are an error, for 64 bits would not hold the sums. Ids and
    labels are whole numbers. Other columns are not looked at. An empty table gives no rows.
    """
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.when(~bad, v).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("chosen"))
        .where("id is not null and label is not null and v is not null")
        .groupBy("id").agg(F.min(F.struct("label", "v", "chosen")).alias("r")).select("id", "r.*")
    )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            dims, out = np.diff(v.offsets.to_numpy()), [b""] * len(v)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.floor(v.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim) * float(scale))
                if len(x) and np.abs(x).max(initial=0) > LARGEST:
                    raise ValueError(f"a component times {scale} is beyond {LARGEST}")
                for i, row in zip(at.tolist(), x.astype(np.int64), strict=True):
                    out[i] = packed(row[None])[0].tobytes()
            cols = [batch.column(0), batch.column(1), batch.column(3), pa.array(dims, pa.int32()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "label", "chosen", "dim", "planes"])

    rows = cut(rows.mapInArrow(pack, "id long, label long, chosen boolean, dim int, planes binary"))
    none = F.lit(None).cast("array<struct<score:long,id:long>>")
    anchors = rows.where("chosen").withColumn("positives", none)
    near = _tiles(anchors, rows, ["dim", "label"]).groupBy("dim", "label", "a", "c").applyInArrow(_positives(n_positives), _POSITIVE)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    positives = (
        near.withColumn("place", place).where(F.col("place") <= n_positives)
        .groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("score", "id")).alias("positives"))
    )
    anchors = anchors.drop("positives").join(positives, "id")
    found = _tiles(anchors, rows, ["dim"]).groupBy("dim", "a", "c").applyInArrow(_negatives(n_negatives, low, high), _NEGATIVE)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    return (
        found.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
