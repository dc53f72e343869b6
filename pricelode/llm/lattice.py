"""Language-model scores from subword lattices.

A word has many segmentations into the pieces of an existing unigram vocabulary; its
probability is the sum over all of them of the product of their pieces' probabilities,
by a forward recursion in log space. The vocabulary's own scores give the first
probabilities (by rank, as 1 / (rank + SHIFT)); forward-backward passes over all
training words re-estimate them. A text is its words, each with the word-start sign,
and one end piece; characters without a piece are spelled in byte pieces. So piece
probabilities sum to one and a text's score is its marginal log10 probability.

Pieces never cross a word start, so a word's lattice is run once, however often it
occurs. Frequent words (at most FREQUENT, each at least that share of the training
tokens) go with the tasks that read the texts; of the rest an inverted index by blocks
of texts is joined to the table of words, and the sums return to the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A word with at least 1/FREQUENT of all training tokens is frequent; there are no more than FREQUENT.
FREQUENT = 200_000
#: Distinct words that a counting task holds, texts and characters of an index block, words of a lattice batch.
HELD, BLOCK_TEXTS, BLOCK_CHARS, WORDS = 400_000, 20_000, 12_000_000, 20_000
SHIFT, PRIOR = 10.0, 2000.0
#: Tasks that send partial sums of piece counts, at most.
PARTS = 512

START = "▁"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class Lattice:
    """Pieces in a tree, and the recursions over batches of words.

    pieces: (piece, score) of an existing vocabulary; those that no lower-case word can
    hold are left out. Numbers: pieces first, then 256 bytes, then the end piece.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]]):
        fit = lambda p: p and START not in p[1:] and not any("A" <= c <= "Z" for c in p)
        ranked = [p for p, _ in sorted(pieces, key=lambda x: (-x[1], x[0])) if fit(p)]
        self.number = {p: i for i, p in enumerate(dict.fromkeys(ranked))}
        self.byte0 = len(self.number)
        self.end = self.byte0 + 256
        edges: dict[tuple[int, int], int] = {}
        owner = [-1]
        for p, i in self.number.items():
            node = 0
            for c in p:
                node = edges.setdefault((node, ord(c)), len(owner))
                if node == len(owner):
                    owner.append(-1)
            owner[node] = i
        keys = np.array([(a << 21) | c for a, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(edges.values()), np.int64)[order], 0)
        self.owner = np.array(owner)
        self.longest = max(map(len, self.number), default=1)

    def prior(self) -> np.ndarray:
        """Probabilities by the vocabulary's own order; bytes share one rank, the end has one."""
        w = 1 / (np.arange(self.byte0) + SHIFT)
        p = np.concatenate([w, np.full(256, 1 / ((self.byte0 + SHIFT) * 256)), [1 / SHIFT]])
        return p / p.sum()

    def _edges(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """chars: words x length; of all edges the word, start, end, and piece number
        (-1: the character in bytes)."""
        lengths = np.array([len(t) for t in texts])
        width = int(lengths.max())
        chars = np.zeros((len(texts), width), np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars[np.arange(width) < lengths[:, None]] = flat
        w, s = np.nonzero(np.arange(width) < lengths[:, None])
        out = []
        node, at, start, word = np.zeros(len(w), np.int64), s.copy(), s, w
        covered = np.zeros_like(chars, bool)
        for _ in range(self.longest):
            key = (node << 21) | chars[word, at]
            i = np.searchsorted(self.keys, key)
            go = self.keys[i] == key
            node, at, start, word = self.child[i[go]], at[go] + 1, start[go], word[go]
            piece = self.owner[node]
            has = piece >= 0
            out.append((word[has], start[has], at[has], piece[has]))
            one = has & (at == start + 1)
            covered[word[one], start[one]] = True
            inside = at < lengths[word]
            node, at, start, word = node[inside], at[inside], start[inside], word[inside]
            if not len(node):
                break
        bare = ~covered[w, s]
        out.append((w[bare], s[bare], s[bare] + 1, np.full(bare.sum(), -1)))
        return chars, lengths, *(np.concatenate(x) for x in zip(*out, strict=True))

    def _spelled(self, chars: np.ndarray) -> list[list[int]]:
        return [[self.byte0 + b for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars.tolist()]

    def forward(self, texts: list[str], logp: np.ndarray, counts: np.ndarray | None = None, soft: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word, summed over all segmentations. With counts and
        soft, adds each piece's expected number of uses to soft."""
        chars, lengths, word, start, end, piece = self._edges(texts)
        cost = logp[piece]
        bare = np.flatnonzero(piece < 0)
        spelled = self._spelled(chars[word[bare], start[bare]])
        cost[bare] = [sum(logp[b] for b in s) for s in spelled]
        width = chars.shape[1]
        alpha = np.full((len(texts), width + 1), -np.inf)
        alpha[:, 0] = 0
        _sweep(alpha, word, start, end, cost, range(1, width + 1))
        total = alpha[np.arange(len(texts)), lengths]
        if soft is not None:
            beta = np.full((len(texts), width + 1), -np.inf)
            beta[np.arange(len(texts)), lengths] = 0
            _sweep(beta, word, end, start, cost, range(width - 1, -1, -1))
            use = np.exp(alpha[word, start] + cost + beta[word, end] - total[word]) * counts[word]
            used = piece >= 0
            soft += np.bincount(piece[used], use[used], len(soft))
            for k, s in zip(bare.tolist(), spelled, strict=True):
                for b in s:
                    soft[b] += use[k]
        return total


def _sweep(table: np.ndarray, word: np.ndarray, from_: np.ndarray, to: np.ndarray, cost: np.ndarray, places: Iterable[int]) -> None:
    """Fills table[word, place] = log sum exp over the edges that lead to the place."""
    order = np.lexsort((word, to))
    bounds = np.searchsorted(to[order], np.arange(table.shape[1] + 1))
    for p in places:
        e = order[bounds[p] : bounds[p + 1]]
        if not len(e):
            continue
        w, x = word[e], table[word[e], from_[e]] + cost[e]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        top = np.maximum.reduceat(x, first)
        size = np.diff(np.append(first, len(w)))
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            value = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, size)), first))
        rows = w[first]
        table[rows, p] = np.logaddexp(table[rows, p], value)


def _batches(column: pa.Array, *others: pa.Array, most: int = 400_000) -> Iterator[tuple]:
    """Slices of words of like length, with START before each, and their places."""
    found = [START + w.decode("utf-8", "surrogatepass") for w in column.to_pylist()]
    order = sorted(range(len(found)), key=lambda i: len(found[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < WORDS and (hi - lo + 1) * len(found[order[hi]]) <= most:
            hi += 1
        yield [found[i] for i in order[lo:hi]], np.array(order[lo:hi])
        lo = hi


_COUNTS = "word binary, c long, d long"


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c: in training texts; d: training texts, with the word b'' only."""
    held: dict[bool, Counter] = {True: Counter(), False: Counter()}
    texts = 0

    def flush() -> pa.RecordBatch:
        keys = list(held[True].keys() | held[False].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array([*keys, b""], pa.binary()), pa.array([*(held[True][k] for k in keys), 0], pa.int64()), pa.array([0] * len(keys) + [texts], pa.int64())], ["word", "c", "d"]
        )
        held[True].clear()
        held[False].clear()
        return out

    for batch in batches:
        for train, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held[train].update(words(text.as_py()))
            texts += train
            if len(held[True]) + len(held[False]) > HELD:
                yield flush()
                texts = 0
    yield flush()


def _expected(lattice: Lattice, p: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        soft, logp = np.zeros(len(p)), np.log(p)
        for batch in batches:
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            for texts, at in _batches(batch.column(0)):
                lattice.forward(texts, logp, counts[at], soft)
        some = np.flatnonzero(soft)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(soft[some])], ["piece", "n"])

    return run


def _scored(lattice: Lattice, p: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = np.log(p)
        for batch in batches:
            out = np.empty(len(batch))
            for texts, at in _batches(batch.column(0)):
                out[at] = lattice.forward(texts, logp) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["word", "c", "lat"])

    return run


_INDEX = "word binary, block long, docs array<int>, counts array<int>, doc_id {}, tokens long, known long, base double, lat double"


def _index(frequent: dict[bytes, tuple[bool, float, float]]) -> Callable:
    """For each text a row with what its frequent words give, under a word that no text
    has; and for each other word of a block of texts a row with the texts that hold it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[tuple] = []
        docs: dict[bytes, list[int]] = {}
        counts: dict[bytes, list[int]] = {}
        # partitions with equal rows in equal order are different blocks
        mark, size = xxhash.xxh3_64(b"%d " % TaskContext.get().partitionId()), 0

        def flush() -> pa.RecordBatch:
            block = mark.intdigest() - (1 << 63)
            rare, n = list(docs), len(ids)
            tokens, known, base, lat = zip(*parts, strict=True) if parts else ((), (), (), ())
            none = [None] * len(rare)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*(b" %d %d" % (block, i) for i in range(n)), *rare], pa.binary()), pa.array([block] * (n + len(rare)), pa.int64()),
                    pa.array([*([i] for i in range(n)), *docs.values()], pa.list_(pa.int32())),
                    pa.array([*([1] for _ in range(n)), *(counts[w] for w in rare)], pa.list_(pa.int32())),
                    pa.array([*ids, *none], kind), pa.array([*tokens, *none], pa.int64()), pa.array([*known, *none], pa.int64()),
                    pa.array([*base, *none], pa.float64()), pa.array([*lat, *none], pa.float64()),
                ],
                ["word", "block", "docs", "counts", "doc_id", "tokens", "known", "base", "lat"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                found = words(raw)
                known, base, lat, i = 0, 0.0, 0.0, len(ids)
                for w, n in Counter(found).items():
                    f = frequent.get(w)
                    if f:
                        known += n * f[0]
                        base += n * f[1]
                        lat += n * f[2]
                    elif w in docs:
                        docs[w].append(i)
                        counts[w].append(n)
                    else:
                        docs[w], counts[w] = [i], [n]
                ids.append(doc_id)
                parts.append((len(found), known, base, lat))
                mark.update(f"{doc_id} {len(found)} ".encode() + (found[0] + b" " + found[-1] if found else b""))
                size += len(raw or "")
                if len(ids) >= BLOCK_TEXTS or size > BLOCK_CHARS:
                    yield flush()
                    ids, parts, docs, counts, size = [], [], {}, {}, 0
        if ids:
            yield flush()

    return run


def lattice_scores(docs: DataFrame, pieces: Sequence[tuple[str, float]], train: str = "crc32(cast(doc_id as string)) % 5 <> 1", rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    docs: doc_id, text. A-Z count as a-z; tokens are the words between ASCII blanks and
    one end. base_score: sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))) with
    c the token's count, N all and V distinct tokens of the training rows (SQL `train`;
    null counts as true). score: log10 probability of the text under the lattice model
    learnt from the same rows. A null or empty text is the end alone. Repeated rows
    give equal rows. Without training rows the vocabulary's own scores stand. Other
    columns are not looked at; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    used = F.coalesce(F.expr(train), F.lit(True))
    counted = docs.select(used.alias("train"), "text").mapInArrow(_count, _COUNTS).groupBy("word").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    types = cut(counted)
    sums = types.agg(F.sum("c"), F.sum("d"), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = sums[1] or 0
    total, distinct = (sums[0] or 0) + ends, sums[2] + (ends > 0)
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    types = types.where("word <> X''").select("word", "c")

    lattice = Lattice(pieces)
    p = prior = lattice.prior()
    few = types.where("c > 0").coalesce(PARTS)
    for _ in range(rounds if total else 0):
        soft = prior * PRIOR
        soft[lattice.end] += ends
        for r in few.mapInArrow(_expected(lattice, p), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            soft[r["piece"]] += r["n"]
        p = soft / soft.sum()
    scored = cut(types.mapInArrow(_scored(lattice, p), "word binary, c long, lat double"))
    common = scored.where(F.col("c") * FREQUENT >= max(total, 1)).collect()
    frequent = {bytes(r["word"]): (r["c"] > 0, base(r["c"]), r["lat"]) for r in common}

    constant = math.log10(total + 0.5 * (distinct + 1))
    rows = docs.select("doc_id", "text").mapInArrow(_index(frequent), _INDEX.format(kind)).join(scored.withColumnRenamed("lat", "word_lat"), "word", "left")
    text = F.col("tokens").isNotNull()
    each = rows.select(
        "block", "doc_id", F.explode(F.arrays_zip("docs", "counts")).alias("x"), "tokens",
        F.when(text, F.col("known")).otherwise((F.col("c") > 0).cast("long")).alias("known"),
        F.when(text, F.col("base")).otherwise(F.log10(F.col("c") + 0.5) - constant).alias("base"),
        F.when(text, F.col("lat")).otherwise(F.col("word_lat")).alias("lat"),
    )
    n = F.col("x.counts")
    texts = each.groupBy("block", F.col("x.docs").alias("doc")).agg(
        F.max("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"),
        F.sum(n * F.col("known")).alias("known"), F.sum(n * F.col("base")).alias("base"), F.sum(n * F.col("lat")).alias("lat"),
    )
    return texts.select(
        "doc_id", F.coalesce(~F.expr(train), F.lit(False)).alias("held_out"), (F.col("tokens") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + base(ends)).alias("base_score"), (F.col("lat") + float(np.log10(p[lattice.end]))).alias("score"),
    )


def sentencepieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not odd(i)]
