"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected onto random directions. Near vectors fall near each other
on every line: a window centred at one of them holds the other on most lines, while
vectors that are not near share few windows. A pair is verified if the number of lines
on which it collides passes a count that a pair at the threshold misses with
probability MISS_COUNT.

Windows on single lines hold a fixed share of all pairs, however many vectors there
are. So pairs are only counted where the lines of one of several tables sort them into
the same cell; a table has more lines the more vectors there are, and there are so
many tables that a pair at the threshold shares none with probability MISS_TABLES.
Recall at the threshold is at least 1 - MISS_TABLES - MISS_COUNT, higher above it.

Equal vectors are one class first. A cell with many vectors is dealt into blocks, each
pair of blocks is compared by itself, and only sums and connecting links leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

MISS_TABLES, MISS_COUNT = 0.002, 0.0001
#: Width of a cell, half width of a window, lines that are counted, vectors of a block.
CELL, WINDOW, LINES, BLOCK = 2.0, 0.5, 48, 512
#: Groups of up to so many are compared many groups at once.
SMALL = 32


def _within(d: float, w: float) -> float:
    """Share of lines on which vectors at distance d are no more than w apart."""
    return math.erf(w / (d * math.sqrt(2)))


def _same_cell(d: float) -> float:
    r = CELL / d
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Plan:
    """Lines and tables for n vectors and a cosine threshold."""

    def __init__(self, n: int, threshold: float, seed: int = 4):
        near = math.sqrt(2 - 2 * threshold)
        self.threshold, self.seed = threshold, seed
        self.lines = max(2, math.ceil(math.log(4 * max(n, 1)) / -math.log(_same_cell(math.sqrt(2)))))
        self.tables = max(1, math.ceil(math.log(MISS_TABLES) / math.log(1 - _same_cell(near) ** self.lines)))
        p, miss, self.least = _within(near, WINDOW), 0.0, 0
        while (miss := miss + math.comb(LINES, self.least) * p**self.least * (1 - p) ** (LINES - self.least)) <= MISS_COUNT:
            self.least += 1

        self._drawn: dict[int, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_drawn": {}}

    def drawn(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tables' lines and offsets, and the lines that are counted, for vectors of this length."""
        if dim not in self._drawn:
            rng = np.random.default_rng((self.seed, dim))
            n = self.tables * self.lines
            self._drawn[dim] = rng.standard_normal((dim, n)), rng.uniform(0, CELL, n), rng.standard_normal((dim, LINES))
        return self._drawn[dim]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """vectors x tables: a hash of each table's cell."""
        n, dim = unit.shape
        lines, offsets, _ = self.drawn(dim)
        out = np.full((n, self.tables), np.uint64(dim))
        for lo in range(0, n, 2048):
            cells = np.floor((unit[lo : lo + 2048] @ lines + offsets) / CELL).astype(np.int64).view(np.uint64).reshape(-1, self.tables, self.lines)
            part = out[lo : lo + 2048]
            for j in range(self.lines):
                part[:] = (part ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
                part ^= part >> np.uint64(29)
        return out.view(np.int64)

    def sorted_lines(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.drawn(unit.shape[1])[2]).astype(np.float32)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """len(x) x len(y): which pairs collide on enough lines; x, y: places on the lines.
        On each line y is sorted, and the window around each of x is a range of it."""
        count = np.zeros((len(x), len(y) + 1), np.int16)
        total = np.zeros((len(x), len(y)), np.int16)
        rows = np.arange(len(x))
        for j in range(LINES):
            order = np.argsort(y[:, j])
            lo, hi = np.searchsorted(y[order, j], x[:, j] - WINDOW, "left"), np.searchsorted(y[order, j], x[:, j] + WINDOW, "right")
            count[:] = 0
            count[rows, lo] += 1
            count[rows, hi] -= 1
            total[:, order] += np.cumsum(count[:, :-1], axis=1, dtype=np.int16)
        return total >= self.least


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _linked(plan: Plan, rows: dict[str, np.ndarray], bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(node, another node of its component, linked vectors) for the rows that have
    links within their groups. rows: t, node, copies, own, v; bounds: where groups
    begin, and the end. A pair counts in the first table only in which it shares a cell."""
    unit = _unit(rows["v"])
    line = plan.sorted_lines(unit)
    size, own = np.diff(bounds), rows["own"]
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        a, b = np.triu_indices(n, 1)
        first = bounds[:-1][size == n][:, None]
        i.append((first + a).ravel())
        j.append((first + b).ravel())
    i, j = np.concatenate(i), np.concatenate(j)
    # of two different blocks only pairs across count
    mixed = np.repeat(np.minimum.reduceat(own, bounds[:-1]) != np.maximum.reduceat(own, bounds[:-1]), size) if len(own) else np.empty(0, bool)
    keep = ~mixed[i] | (own[i] != own[j])
    i, j = i[keep], j[keep]
    near = [((np.abs(line[i[lo : lo + 100_000]] - line[j[lo : lo + 100_000]]) <= WINDOW).sum(1) >= plan.least) for lo in range(0, len(i), 100_000)]
    near = np.concatenate(near) if near else np.empty(0, bool)
    i, j = [i[near]], [j[near]]
    for g in np.flatnonzero(size > SMALL).tolist():
        at = np.arange(bounds[g], bounds[g + 1])
        a, b = (at[own[at] == own[at].min()], at[own[at] == own[at].max()]) if mixed[at[0]] else (at, at)
        x, y = np.nonzero(plan.near(line[a], line[b]))
        x, y = a[x], b[y]
        once = slice(None) if mixed[at[0]] else x < y
        i.append(x[once])
        j.append(y[once])
    i, j = np.concatenate(i), np.concatenate(j)
    good = np.concatenate([np.einsum("ij,ij->i", unit[i[lo : lo + 50_000]], unit[j[lo : lo + 50_000]]) >= plan.threshold for lo in range(0, len(i), 50_000)] or [np.empty(0, bool)])
    i, j = i[good], j[good]
    if not len(i):
        return []
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    keys, ki, kj = plan.keys(unit[used]), at[: len(i)], at[len(i) :]
    new = np.ones(len(i), bool)
    for t in range(int(rows["t"][i].max())):
        new &= ~((keys[ki, t] == keys[kj, t]) & (rows["t"][i] > t))
    i, j = i[new], j[new]
    links = np.bincount(i, rows["copies"][j], len(own)) + np.bincount(j, rows["copies"][i], len(own))
    root = list(range(len(own)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    node = rows["node"]
    return [(int(node[x]), int(node[top(x)]), int(links[x])) for x in np.flatnonzero(links).tolist()]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept for each row of `vectors`.

    Two vectors of the same length are linked if their cosine in double precision is
    >= threshold. n_links counts the other rows linked directly, component_id is the
    smallest id reachable, kept is id = component_id. Vectors that are null, empty,
    zero or hold null or non-finite components have no links and are their own
    component. Rows with the same id are one vertex; rows without an id count as
    linked vectors, but name no component unless all of it lacks ids. Other columns
    are not looked at. An empty table gives no rows.
    """
    v = F.col(column).cast("array<double>")
    ok = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.when(F.coalesce(ok, F.lit(False)), v).alias("v"))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else xxhash.xxh3_128_hexdigest((np.array(x) + 0.0).tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(1)], ["id", "digest", "v"])

    rows = cut(rows.mapInArrow(digest, "id long, digest string, v array<double>"))
    classes = cut(
        rows.where("digest is not null").groupBy("digest")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
        # classes without any id get numbers below all ids that hardly clash
        .withColumn("node", F.coalesce("least", -F.shiftrightunsigned(F.xxhash64("digest"), 2) - (1 << 62)))
    )
    plan = Plan(classes.count(), threshold)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for _, part in frame.groupby(frame["v"].map(len)):
                keys = plan.keys(_unit(np.array(part["v"].tolist(), np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(part["node"], pa.int64()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "keys"])

    keys = classes.select("node", "v").mapInArrow(keyed, "node long, keys array<long>").select("node", F.posexplode("keys").alias("t", "key"))
    sizes = keys.groupBy("t", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        keys.join(sizes, ["t", "key"])
        .withColumn("own", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int")).withColumn("other", other)
        .select("t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "own")
        .join(classes.select("node", "copies", "v"), "node").select("t", "key", "p", "q", "node", "own", "copies", "v")
        .repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q", "node")
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_groups(batches, 4):
            rows = {c: table.column(c).to_numpy() for c in ("t", "node", "copies", "own")}
            v = table.column("v").combine_chunks()
            dims = np.diff(v.offsets.to_numpy())
            cut_at = np.concatenate([[0], np.flatnonzero(np.diff(dims)) + 1, [len(dims)]])
            for lo, hi in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True):
                part = {c: x[lo:hi] for c, x in rows.items()} | {"v": v.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)}
                inside = bounds[(bounds >= lo) & (bounds <= hi)] - lo
                found = _linked(plan, part, inside)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v", "links"])

    found = cut(dealt.mapInArrow(compare, "u long, v long, links long"))
    component = connected_components(found.select("u", "v"))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = (
        classes.select("digest", "node", "copies", "least").join(links, "node", "left").join(component, "node", "left")
        .select(
            "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "least").alias("component"),
        )
    )
    return rows.join(named, "digest", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )


def _whole_groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches, cut so that each group of equal first columns is whole; and where groups begin, with the end."""
    held: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for c in range(n_keys):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), len(t))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        b = bounds(held)
        if len(b) > 2:  # the last group may go on
            yield held.slice(0, b[-2]).combine_chunks(), b[:-1]
            held = held.slice(b[-2])
    if held is not None and len(held):
        yield held.combine_chunks(), bounds(held)
