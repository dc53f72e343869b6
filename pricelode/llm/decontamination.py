"""Benchmark decontamination by latent semantic retrieval.

The words of the benchmark items are the terms. Passages of the corpus (PASSAGE words)
and the items make a TF-IDF matrix; a distributed randomised SVD of it (one product
with its Gram matrix for the range, one more for the Rayleigh-Ritz step) gives RANK
latent directions. All texts are then searched in windows that overlap: a window whose
latent vector comes near an item's, by its cosine and by its
length along the item's, is a candidate, and is confirmed by the longest
common subsequence of words with the item and with the item's answer.

A long item is searched by overlapping parts, each of which leads to the whole item.
Items that latent vectors can't tell apart, very short ones and those made of common
words, are found by the places of their words instead.

Counts and products cover all passages of all documents. What goes with the tasks is
the terms, RANK numbers for each, and the items; items are handled in blocks of at most
ITEM_BYTES, which bounds it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut

PASSAGE, RANK, EXTRA = 64, 64, 8
#: A term in more than this share of the passages, and in more than so many, has no weight.
COMMON, COMMON_LEAST = 0.1, 30
#: Windows are sums of steps of STEP words: for each width in steps, items of up to 2/3 of it.
STEP, WIDTHS = 8, (3, 6, 12, 24, 48)
#: Longer items are searched by parts of PART words, each so many words after the one before.
PART, PART_STEP = 256, 128
#: Items of fewer words, and items with less than the share KEPT of their weight (a common term's is FLOOR at least), are found by the places of their words.
SHORT, KEPT, FLOOR = 8, 0.5, 0.5
#: Text of the items of one block.
ITEM_BYTES = 4 << 20
#: Tasks that send partial products, at most.
PARTS = 1024
#: Terms multiplied at once, and bytes of a batch searched at once: their tables of RANK numbers a word fit a core's cache.
AT_ONCE, PART_BYTES = 50_000, 500_000

_BLANKED = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_SENTENCES = re.compile(r"[.!?\n]+")


def terms(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split() if text else []


def answer_of(text: str) -> list[bytes]:
    """The last sentence of at least three words, else the last quarter of the words."""
    sentences = [w for s in _SENTENCES.split(text) if len(w := terms(s)) >= 3]
    w = terms(text)
    return sentences[-1] if len(sentences) > 1 else w[-max(1, len(w) // 4) :]


def common_subsequence(masks: dict[int, int], n: int, other: Iterable[int]) -> int:
    """Length of the longest common subsequence of a sequence of n symbols, given as
    symbol -> bits of its places, and another; bit-parallel."""
    row = full = (1 << n) - 1
    for x in other:
        u = row & masks.get(x, 0)
        row = (row + u | row - u) & full
    return n - row.bit_count()


def masks_of(ids: Iterable[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(ids):
        out[x] = out.get(x, 0) | 1 << i
    return out


@dataclass
class Item:
    item_id: int
    ids: list[int]
    answer: list[int]


@dataclass
class Model:
    index: dict[bytes, int]
    items: list[Item]
    weights: np.ndarray  # idf by term, 0 for common ones
    basis: np.ndarray  # terms x RANK
    df: np.ndarray  # passages and items by term
    weak: list[bool]  # by item: common words have most of its weight


def numbers(text: str | None, index: dict[bytes, int]) -> np.ndarray:
    """Term numbers of the words of a text, -1 for words that no item has."""
    found = terms(text)
    return np.fromiter(map(index.get, found, repeat(-1)), np.int32, len(found))


# -- what the corpus says about the terms -----------------------------------


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column(batch.schema.get_field_index("ids")):
            yield np.frombuffer(x.as_py(), np.int32)


def _passages(texts: Iterable[np.ndarray], most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(term numbers, passage numbers) of the words that are terms, some texts at a time."""
    ids, at, n, p = [], [], 0, 0

    for x in texts:
        keep = np.flatnonzero(x >= 0)
        ids.append(x[keep])
        at.append(p + keep // PASSAGE)
        p += len(x) // PASSAGE + 1
        n += len(keep)
        if n > most:
            yield np.concatenate(ids), np.concatenate(at)
            ids, at, n, p = [], [], 0, 0
    if n:
        yield np.concatenate(ids), np.concatenate(at)


def _frequencies(n_terms: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages = np.zeros(n_terms, np.int64), 0

        def counted() -> Iterator[np.ndarray]:
            nonlocal passages
            for x in _rows(batches):
                passages += -(-len(x) // PASSAGE)
                yield x

        for ids, at in _passages(counted()):
            pairs = np.unique(at.astype(np.int64) * n_terms + ids)
            df += np.bincount(pairs % n_terms, minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], passages), pa.int64())], ["term", "n"]
        )

    return run


def gram_product(ids: np.ndarray, at: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T (A basis) for the matrix of these passages, A = term counts times weights."""
    heavy = weights[ids] > 0
    ids, at = ids[heavy], at[heavy]
    out = np.zeros_like(basis)
    if not len(ids):
        return out
    weighted = basis * weights[:, None]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    y = np.add.reduceat(weighted[ids], first)
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
    # 16-bit numbers are sorted by radix
    order = np.argsort(ids.astype(np.uint16) if len(basis) <= 65_536 else ids, kind="stable")
    by_term = ids[order]
    begin = np.flatnonzero(np.diff(by_term, prepend=-1))
    out[by_term[begin]] = np.add.reduceat(y[row[order]], begin)
    return out * weights[:, None]


def _products(weights: np.ndarray, basis: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape, np.float64)
        for ids, at in _passages(_rows(batches)):
            total += gram_product(ids, at, weights, basis)
        some = np.flatnonzero(total.any(1))
        flat = pa.array(total[some].ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.FixedSizeListArray.from_arrays(flat, basis.shape[1]).cast(pa.list_(pa.float64()))], ["term", "v"]
        )

    return run


def _product(coded: DataFrame, weights: np.ndarray, basis: np.ndarray, items: list[Item], share: float) -> np.ndarray:
    """A^T (A basis) over the corpus and the items, the items' part scaled to `share` of it."""
    columns = basis.shape[1]
    sums = (
        coded.mapInArrow(_products(weights, basis), "term int, v array<double>")
        .groupBy("term").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(columns)]).alias("v"))
    )
    out = np.zeros(basis.shape)
    for r in sums.toLocalIterator():
        out[r["term"]] = r["v"]
    own = sum(gram_product(ids, at, weights, basis) for ids, at in _passages(np.array(i.ids, np.int32) for i in items))
    size = np.linalg.norm(own)
    return out + own * (share * (np.linalg.norm(out) or size) / size if size else 0)


def fit(docs: DataFrame, items: list[tuple[object, str, str | None]], seed: int = 5) -> tuple[Model, DataFrame]:
    """Term weights and latent directions; and for each row of `docs` with a text its
    doc_id and term numbers. items: (item_id, text, answer or None)."""
    index: dict[bytes, int] = {}
    number = lambda ws: [index.setdefault(w, len(index)) for w in ws]
    known = [Item(i, number(terms(t)), number(terms(a) if a else answer_of(t))) for i, t, a in items]
    known = [i for i in known if i.ids]
    n = len(index)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([numbers(x.as_py(), index).tobytes() for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary"
    coded = cut(docs.select("doc_id", "text").where("text is not null").mapInArrow(code, schema))
    summed = coded.select("ids").coalesce(PARTS)
    counts = {r["term"]: r["n"] for r in summed.mapInArrow(_frequencies(n), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    passages = counts.pop(-1, 0) + len(known)
    df = np.bincount([t for i in known for t in set(i.ids)], minlength=n)
    for t, c in counts.items():
        df[t] += c
    idf = np.log(passages / np.maximum(df, 1))
    weights = np.where(df <= max(COMMON * passages, COMMON_LEAST), idf, 0).astype(np.float32)
    if not weights.any():  # a corpus so small that every term is common
        weights = np.ones(n, np.float32)

    def is_weak(ids: list[int]) -> bool:
        term, count = np.unique(ids, return_counts=True)
        mass = (count * np.maximum(idf[term], FLOOR)) ** 2
        return bool(mass[weights[term] > 0].sum() < KEPT * mass.sum())

    basis = np.random.default_rng(seed).standard_normal((n, min(n, RANK + EXTRA))).astype(np.float32)
    for last in (False, True):
        basis = np.linalg.qr(basis)[0].astype(np.float32)
        product = _product(summed, weights, basis, known, 1.0)
        if last:  # Rayleigh-Ritz: the leading directions within the range
            values, turn = np.linalg.eigh(basis.T.astype(np.float64) @ product)
            basis = (basis @ turn[:, np.argsort(-values)[:RANK]]).astype(np.float32)
        else:
            basis = product
    return Model(index, known, weights, basis, df, [is_weak(i.ids) for i in known]), coded


# -- search ------------------------------------------------------------------


class Searcher:
    """Finds items in texts."""

    def __init__(self, model: Model, cosine: float, verbatim: float, paraphrase: float, answer: float):
        self.model, self.cosine, self.limits = model, cosine, (verbatim, paraphrase, answer)
        self.project = model.basis * model.weights[:, None]
        self.masks = [(masks_of(i.ids), masks_of(i.answer)) for i in model.items]
        self.probes = [(k, at, i.ids[at : at + PART] if len(i.ids) > PART else i.ids) for k, i in enumerate(model.items) for at in part_starts(len(i.ids))]
        vectors = np.array([self.project[x].sum(0) for _, _, x in self.probes], np.float32).reshape(len(self.probes), -1)
        self.length = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        self.unit = vectors / self.length[:, None]
        lengths = np.array([len(x) for _, _, x in self.probes])
        least = np.searchsorted([w * STEP * 2 / 3 for w in WIDTHS], lengths)
        self.by_width = {k: np.flatnonzero(np.minimum(least, len(WIDTHS) - 1) == k) for k in range(len(WIDTHS))}
        self.exact = [k for k, i in enumerate(model.items) if len(i.ids) < SHORT or model.weak[k]]
        self.placed = np.zeros(len(model.df), bool)
        for k in self.exact:
            self.placed[model.items[k].ids] = True

    def find(self, ids: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float]]:
        """Of texts given as term numbers: (number of the text, number of the item, cosine, share of the item's words in
        order, share of the answer's), the best place of each pair that is confirmed."""
        steps = [-(-len(x) // STEP) for x in ids]
        starts = np.cumsum([0, *steps])
        total = int(starts[-1])
        if not total or not self.model.items:
            return
        sums = np.zeros((total + 1, self.project.shape[1]), np.float32)
        for lo in range(0, len(ids), 64):
            part = ids[lo : lo + 64]
            at = np.concatenate([s + np.arange(len(x)) // STEP for s, x in zip(starts[lo:], part, strict=False)])
            flat = np.concatenate(part)
            keep = flat >= 0
            keep[keep] = self.model.weights[flat[keep]] > 0
            flat, at = flat[keep], at[keep]
            if len(flat):
                first = np.flatnonzero(np.diff(at, prepend=-1))
                sums[at[first]] = np.add.reduceat(self.project[flat], first)
        upto = np.zeros((total + 1, sums.shape[1]))
        np.cumsum(sums[:total], axis=0, out=upto[1:], dtype=np.float64)
        owner = np.repeat(np.arange(len(ids)), steps)
        end = starts[1:][owner]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        self._by_places(best, ids)
        seen: set[tuple[int, int, int]] = set()
        for k, chosen in self.by_width.items():
            if not len(chosen):
                continue
            width, stride = WIDTHS[k], max(1, WIDTHS[k] // 3)
            local = np.arange(total) - starts[:-1][owner]
            begin = np.flatnonzero((local % stride == 0) & ((local == 0) | (local + width - stride < steps_of(steps, owner))))
            for lo in range(0, len(begin), 8192):
                b = begin[lo : lo + 8192]
                window = (upto[np.minimum(b + width, end[b])] - upto[b]).astype(np.float32)
                norm = np.linalg.norm(window, axis=1, keepdims=True)
                along = window @ self.unit[chosen].T
                cosines = along / np.maximum(norm, 1e-12)
                # a window that holds most of an item reaches as far along it as these words do
                near_item = (cosines >= self.cosine) & (along >= self.cosine * self.length[chosen])
                last, near, there = -1, [], set()
                for r, c in zip(*(x.tolist() for x in np.nonzero(near_item)), strict=True):
                    t = owner[b[r]]
                    if r != last:  # the window and half its width more on either side
                        at = int(b[r] - starts[t]) * STEP
                        near = ids[t][max(0, at - width * STEP // 2) : at + width * STEP * 3 // 2].tolist()
                        last, there = r, set(near)
                    item, offset, part = self.probes[chosen[c]]
                    n = len(self.model.items[item].ids)
                    if n == len(part):
                        self._confirm(best, int(t), item, float(cosines[r, c]), near, there)
                        continue
                    # where the whole item lies if this part of it is here, and half as much and a window's width more
                    at, more = int(b[r] - starts[t]) * STEP, width * STEP
                    place = (int(t), item, (at - offset) // PART_STEP)
                    if place not in seen:
                        seen.add(place)
                        span = ids[t][max(0, at - offset * 3 // 2 - more) : at + (n - offset) * 3 // 2 + 2 * more].tolist()
                        self._confirm(best, int(t), item, float(cosines[r, c]), span, set(span))
        for (t, i), found in best.items():
            yield t, i, *found

    def _by_places(self, best: dict, ids: list[np.ndarray]) -> None:
        """Items of `exact`: wherever as many of an item's words as are needed stand close enough together."""
        if not self.exact:
            return
        begin = np.cumsum([0, *(len(x) + 1 for x in ids)])
        flat = np.full(int(begin[-1]), -1, np.int32)
        for b, x in zip(begin, ids, strict=False):
            flat[b : b + len(x)] = x
        at = np.flatnonzero(flat >= 0)
        at = at[self.placed[flat[at]]]
        at = at[np.argsort(flat[at], kind="stable")]
        first = np.searchsorted(flat[at], np.arange(len(self.placed) + 1))
        verbatim, paraphrase, _ = self.limits
        for item in self.exact:
            words = self.model.items[item].ids
            n, short = len(words), len(words) < SHORT
            need = max(1, math.ceil((verbatim if short else min(verbatim, paraphrase)) * n - 1e-9))
            # of so many words, the rarest ones, any match has at least one
            anchors = set(sorted(words, key=self.model.df.__getitem__)[: n - need + 1])
            if not any(first[w] < first[w + 1] for w in anchors):
                continue
            places = np.sort(np.concatenate([at[first[w] : first[w + 1]] for w in set(words)]))
            # as wide as the windows of other items; a short item's words stand closer
            reach, step = (n + max(2, n // 2), 0) if short else (max(6 * STEP, 3 * n), n // 4)
            runs = places[: len(places) - need + 1]
            runs = runs[places[need - 1 :] - runs < reach] if len(runs) else runs
            last = -1 - step
            for p in runs.tolist():
                if p <= last + step:
                    continue
                last, t = p, int(np.searchsorted(begin, p, side="right")) - 1
                near = flat[p : min(p + reach + step, int(begin[t + 1]) - 1)].tolist()
                self._confirm(best, t, item, 0.0, near, set(near), need)

    def _confirm(self, best: dict, text: int, item: int, cosine: float, near: list[int], there: set[int], least_words: int = 0) -> None:
        it, (masks, answer) = self.model.items[item], self.masks[item]
        verbatim, paraphrase, least = self.limits
        need = max(min(verbatim, paraphrase) * len(it.ids), least_words)
        if sum(map(there.__contains__, it.ids)) < need:  # no more words than these can be common
            return
        whole = common_subsequence(masks, len(it.ids), near)
        if whole < need:
            return
        whole /= len(it.ids)
        part = common_subsequence(answer, len(it.answer), near) / len(it.answer) if it.answer else 0.0
        if whole >= verbatim or part >= least:
            best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (cosine, whole, part), key=lambda x: (x[1], x[2], x[0]))


def part_starts(n: int) -> range:
    """Where the parts of an item of n words begin; the last may be shorter, by less than PART_STEP."""
    return range(0, max(1, n - PART + PART_STEP), PART_STEP)


def steps_of(steps: list[int], owner: np.ndarray) -> np.ndarray:
    return np.array(steps)[owner]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str, str | None]]]:
    """The items that have words, in blocks of at most ITEM_BYTES of text (one longer item is a block)."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.where("text is not null").select("item_id", "text", answer.alias("answer")).distinct().orderBy("item_id", "text")
    block, held = [], 0
    for r in rows.toLocalIterator():
        if not terms(r["text"]):
            continue
        if block and held + len(r["text"]) > ITEM_BYTES:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"], r["answer"]))
        held += len(r["text"])
    if block:
        yield block


def _parts(batch: pa.RecordBatch, column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in the column."""
    begin, held, values = 0, 0, batch.column(batch.schema.get_field_index(column))
    for i, size in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
        held += size
        if held > most or i == len(batch) - 1:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0


LIMITS = {"cosine": 0.45, "verbatim": 0.8, "paraphrase": 0.55, "answer": 0.6}
_FOUND = "doc_id {}, item_id {}, cosine double, item_share double, answer_share double"


def leaks(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """doc_id, item_id, cosine, item_share, answer_share: one row for each row of `docs`
    and item that it holds.

    docs: doc_id, text. benchmark: item_id, text, and answer if there is one (else the
    last sentence counts). A window with a latent cosine >= `cosine` (and as large a share of the item's
    vector) is confirmed if
    the longest common subsequence has >= `verbatim` of the item's words, or
    >= `paraphrase` of them and >= `answer` of the answer's. Items that are found by
    the places of their words have cosine 0 (items of fewer than SHORT words so only verbatim). Null, empty and wordless
    texts and items match nothing. Ids are of any type. Repeated rows give repeated results; other columns
    are not looked at; empty tables give no rows.
    """
    limits = LIMITS | limits
    schema = _FOUND.format(*[df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id"))])
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def found(model: Model, coded: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(model, **limits)
            for batch in batches:
                for part in _parts(batch, "ids"):
                    rows = list(searcher.find(list(_rows([part]))))
                    if rows:
                        t, i, c, w, a = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(t)), pa.array([model.items[x].item_id for x in i], kind), *(pa.array(x, pa.float64()) for x in (c, w, a))],
                            ["doc_id", "item_id", "cosine", "item_share", "answer_share"],
                        )

        return coded.mapInArrow(run, schema)

    blocks = [found(*fit(docs, b)) for b in _blocks(benchmark)]
    return reduce(DataFrame.union, blocks) if blocks else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The rows of `docs`, all columns, in which leaks() finds no item."""
    limits, corpus = LIMITS | limits, docs
    for block in _blocks(benchmark):
        # each block's weights are those of the whole corpus, not of what earlier blocks leave
        model, _ = fit(corpus, block)

        def run(batches: Iterable[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(model, **limits)
            for batch in batches:
                for part in _parts(batch, "text"):
                    texts = part.column(part.schema.get_field_index("text")).to_pylist()
                    keep = np.ones(len(part), bool)
                    keep[[t for t, *_ in searcher.find([numbers(x, model.index) for x in texts])]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
