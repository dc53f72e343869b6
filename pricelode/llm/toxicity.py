"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word enters as the mean of the vectors of its features: the whole word and its
character 4- and 5-grams, those that tell the labels apart in the sample; a word with
none of them enters as a blank. A window of WIDTH words runs through a forward and a
backward gated recurrent layer; attention pools the states, a logistic unit scores
them. A text is cut into windows that overlap by WIDTH - STRIDE words, all of them are
scored, and the highest score counts, as one toxic passage makes a text toxic.

The network is trained here with numpy, on a bounded sample of labelled rows: at most
`toxic` documents of label 1 and `clean` of label 0, of at most `max_chars` characters, in the order
of a hash of their ids (a chosen row without a text that fits is not replaced). A label holds for a text, not for its windows; so training
takes, of each toxic text, the window that looks most toxic, first by log odds of its
features and then by the network itself, and of each clean text random windows and the
ones that the network finds worst. Scoring reads whole texts and everything.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, STRIDE = 48, 32
DIM, HIDDEN = 24, 16
#: A feature gets a vector if at least so many texts hold it and its share of toxic ones is so many standard deviations from even.
LEAST, DEVIATIONS = 5, 5.0
#: Windows scored at once, and word types a task remembers.
BATCH, MEMO = 2048, 400_000

_STRIP = ".,;:!?\"'()[]{}<>«»„“”‚’…-"


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def marked(word: str) -> str:
    return f"<{word.strip(_STRIP)}>"


def features(word: str) -> list[str]:
    w = marked(word)
    return [w, *(w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1) if n < len(w))]


@dataclass
class Net:
    index: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    #: Score of a text without words, and of all texts if there was nothing to learn from.
    empty: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_finder"}

    def finder(self) -> ahocorasick.Automaton:
        """Finds in a marked word the features that have vectors: each is a piece of it."""
        if "_finder" not in self.__dict__:
            self._finder = ahocorasick.Automaton()
            for f, i in self.index.items():
                self._finder.add_word(f, i)
            self._finder.make_automaton()
        return self._finder

    @staticmethod
    def fresh(index: dict[str, int], rng: np.random.Generator) -> Net:
        n = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        p = {"E": (rng.standard_normal((len(index), DIM)) * 0.3).astype(np.float32)}
        for d in "fb":
            p |= {f"W{d}": n(DIM, 3 * HIDDEN), f"B{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": n(HIDDEN, 3 * HIDDEN)}
        p |= {"A": n(2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "v": n(HIDDEN), "w": n(2 * HIDDEN), "c": np.full(1, -1.0, np.float32)}
        return Net(index, p)

    def embed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of words; with the features, their word's number, and weights."""
        feats, owner, weight = [], [], []
        find = self.finder().iter if self.index else lambda w: ()
        for i, w in enumerate(words):
            own = [k for _, k in find(marked(w))]
            if not own:
                continue
            feats += own
            owner += [i] * len(own)
            weight += [1 / len(own)] * len(own)
        f, o, g = np.array(feats, np.int64), np.array(owner, np.int64), np.array(weight, np.float32)
        x = np.zeros((len(words), DIM), np.float32)
        if len(f):
            first = np.flatnonzero(np.diff(o, prepend=-1))
            x[o[first]] = np.add.reduceat(self.p["E"][f] * g[:, None], first)
        return x, f, o, g

    def states(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """gates: T x B x 3H, in reading order of this direction; hidden states T x B x H."""
        h, u = np.zeros((gates.shape[1], HIDDEN), np.float32), self.p[f"U{d}"]
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        for t in range(len(gates)):
            hu = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, hu[:, 2 * HIDDEN :], z, r, n))
            h = out[t] = new if mask[t].all() else np.where(mask[t][:, None], new, h)
        return out

    def pool(self, s: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        q = np.tanh(s @ self.p["A"] + self.p["a"])
        e = np.where(mask, q @ self.p["v"], -1e9)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        c = np.einsum("tb,tbk->bk", e, s)
        return c @ self.p["w"] + self.p["c"][0], c, e, q

    def logits(self, gates: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """gates: by direction, of each word type; ids, mask: T x B."""
        f = self.states(gates["f"][ids], mask, "f")
        b = self.states(gates["b"][ids[::-1]], mask[::-1], "b")[::-1]
        return self.pool(np.concatenate([f, b], -1), mask)[0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"B{d}"] for d in "fb"}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def starts(n: int) -> range:
    """Where the windows of n words begin: every STRIDE words, the last one ends at or behind the end."""
    return range(0, max(1, n - WIDTH + STRIDE), STRIDE)


class Scorer:
    """Scores texts; remembers the gate inputs of the words it has seen."""

    def __init__(self, net: Net):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = self.net.gates(np.zeros((1, DIM), np.float32)) if self.net.p else {}
        self.blank: dict[int, float] = {}

    def _ids(self, words: list[str]) -> np.ndarray:
        """Rows of the table; 0 for words without features."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            if len(self.known) + len(new) > MEMO and self.known:
                self.clear()
                new = list(dict.fromkeys(words))
            x, _, owner, _ = self.net.embed(new)
            some = np.unique(owner)
            rows = np.zeros(len(new), np.int64)
            rows[some] = np.arange(len(self.table["f"]), len(self.table["f"]) + len(some))
            self.known.update(zip(new, rows.tolist(), strict=True))
            self.table = {d: np.concatenate([self.table[d], g]) for d, g in self.net.gates(x[some]).items()}
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _run(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        t = np.arange(rows[:, 2].max())[:, None]
        mask = t < rows[:, 2]
        return self.net.logits(self.table, np.where(mask, ids[np.minimum(rows[:, 1] + t, len(ids) - 1)], 0), mask)

    def window_logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the logits of all its windows; none for a text without words."""
        if not self.net.p:
            return [np.empty(0)] * len(texts)
        split = [tokens(t) for t in texts]
        ids = self._ids([w for s in split for w in s])
        ends = np.cumsum([0] + [len(s) for s in split])
        at = np.array([(i, ends[i] + s, min(WIDTH, len(w) - s)) for i, w in enumerate(split) if w for s in starts(len(w))], np.int64).reshape(-1, 3)
        out = np.empty(len(at), np.float32)
        # windows of blanks only differ by their length: each length is run once
        filled = np.concatenate([[0], np.cumsum(ids > 0)])
        blank = filled[at[:, 1] + at[:, 2]] == filled[at[:, 1]]
        for n in np.unique(at[blank, 2]).tolist():
            if n not in self.blank:
                self.blank[n] = float(self._run(np.zeros(n, np.int64), np.array([[0, 0, n]]))[0])
            out[blank & (at[:, 2] == n)] = self.blank[n]
        order = np.flatnonzero(~blank)
        order = order[np.argsort(at[order, 2], kind="stable")]  # windows of like length together
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            out[part] = self._run(ids, at[part])
        return np.split(out, np.cumsum(np.bincount(at[:, 0], minlength=len(texts)))[:-1]) if len(texts) else []

    def scores(self, texts: list[str | None]) -> list[float]:
        return [float(_sigmoid(z.max().astype(np.float64))) if len(z) else self.net.empty for z in self.window_logits(texts)]


# -- training ---------------------------------------------------------------


def _step(net: Net, windows: list[list[str]], y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss."""
    types = list(dict.fromkeys(w for win in windows for w in win))
    number = {w: i + 1 for i, w in enumerate(types)}
    x, feats, owner, weight = net.embed(types)
    x = np.concatenate([np.zeros((1, DIM), np.float32), x])
    t_max = max(map(len, windows))
    ids = np.zeros((t_max, len(windows)), np.int64)
    for j, win in enumerate(windows):
        ids[: len(win), j] = [number[w] for w in win]
    mask = ids > 0
    p, grads, gates = net.p, {}, net.gates(x)
    kept: dict[str, list] = {"f": [], "b": []}
    order = {"f": slice(None), "b": slice(None, None, -1)}
    s = np.concatenate([net.states(gates[d][ids[order[d]]], mask[order[d]], d, kept[d])[order[d]] for d in "fb"], -1)
    logit, c, e, q = net.pool(s, mask)
    dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    grads["w"], grads["c"] = c.T @ dl, dl.sum(keepdims=True)
    dc = dl[:, None] * p["w"]
    de = np.einsum("tbk,bk->tb", s, dc)
    de = e * (de - (e * de).sum(0))
    dq = de[..., None] * p["v"] * (1 - q * q)
    grads["v"] = np.einsum("tb,tbk->k", de, q)
    grads["A"], grads["a"] = np.einsum("tbi,tbj->ij", s, dq), dq.sum((0, 1))
    ds = e[..., None] * dc + dq @ p["A"].T
    dx = np.zeros_like(x)
    for d, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        own, m, dh = ds[order[d], :, half], mask[order[d]], np.zeros((len(y), HIDDEN), np.float32)
        du, dgate = np.zeros_like(p[f"U{d}"]), np.zeros((t_max, len(y), 3 * HIDDEN), np.float32)
        for t in range(t_max - 1, -1, -1):
            h, hn, z, r, n = kept[d][t]
            dh = dh + own[t]
            go, stay = dh * m[t][:, None], dh * ~m[t][:, None]
            dn = go * (1 - z) * (1 - n * n)
            da = np.concatenate([go * (h - n) * z * (1 - z), dn * hn * r * (1 - r), dn], 1)
            dgate[t] = da
            dhu = np.concatenate([da[:, : 2 * HIDDEN], dn * r], 1)
            du += h.T @ dhu
            dh = stay + go * z + dhu @ p[f"U{d}"].T
        flat, where = dgate.reshape(-1, 3 * HIDDEN), ids[order[d]].ravel()
        by_type = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(by_type, where, flat)
        by_type[0] = 0
        grads[f"U{d}"], grads[f"W{d}"], grads[f"B{d}"] = du, x.T @ by_type, flat.sum(0)
        dx += by_type @ p[f"W{d}"].T
    grads["E"] = np.zeros_like(p["E"])
    np.add.at(grads["E"], feats, dx[owner + 1] * weight[:, None])
    return grads


@dataclass
class Sample:
    """Texts as word numbers; of each word the numbers of its features, one word after another."""

    texts: list[np.ndarray]
    words: list[str]
    flat: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Sample:
        number: dict[str, int] = {}
        coded = [np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32) for t in texts]
        sizes = np.zeros(len(number) + 1, np.int64)

        def hashes() -> Iterator[int]:
            for i, w in enumerate(number):
                own = features(w)
                sizes[i + 1] = len(own)
                yield from map(hash, own)

        flat = np.fromiter(hashes(), np.int64)
        return Sample(coded, list(number), np.unique(flat, return_inverse=True)[1].astype(np.int32), np.cumsum(sizes))

    def features(self, text: int) -> np.ndarray:
        """Numbers of a text's distinct features."""
        w = np.unique(self.texts[text])
        size = self.starts[w + 1] - self.starts[w]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.unique(self.flat[np.repeat(self.starts[w], size) + within])


def _telling(sample: Sample, labels: list[int], q: float) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the features that tell the labels apart; for each word of the sample
    the highest log odds of its features. Counts are kept in arrays, as there are many
    more features than those that are named."""
    total = int(sample.flat.max(initial=-1)) + 1
    n, toxic = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for i, label in enumerate(labels):
        own = sample.features(i)
        n[own] += 1
        if label:
            toxic[own] += 1
    far = (n >= LEAST) & (np.abs(toxic - q * n) >= DEVIATIONS * np.sqrt(n * q * (1 - q)))
    ones, zeros = sum(labels), len(labels) - sum(labels)
    odds = np.where(far, np.log((toxic + 0.5) / (ones + 1)) - np.log((n - toxic + 0.5) / (zeros + 1)), 0.0)
    telling = np.logical_or.reduceat(far[sample.flat], sample.starts[:-1])
    names = {f for i in np.flatnonzero(telling) for f, k in zip(features(sample.words[i]), sample.flat[sample.starts[i] : sample.starts[i + 1]], strict=True) if far[k]}
    return {f: i for i, f in enumerate(sorted(names))}, np.maximum.reduceat(odds[sample.flat], sample.starts[:-1])


def train(texts: list[str], labels: list[int], seed: int = 8, rounds: int = 3, epochs: int = 2, batch: int = 128, rate: float = 0.02) -> Net:
    """A network fitted to the texts; one that gives the share of label 1 to every
    text if there is only one label."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Net({}, {}, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    sample = Sample.of(texts)
    if not sample.words:
        return Net({}, {}, float(y.mean()))
    index, value = _telling(sample, labels, float(y.mean()))
    net = Net.fresh(index, rng)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for r in range(rounds):
        if r:
            scorer = Scorer(net)
            found = [z for lo in range(0, len(texts), 64) for z in scorer.window_logits(texts[lo : lo + 64])]
        chosen: list[tuple[list[str], float]] = []
        for i, s in enumerate(sample.texts):
            if not len(s):
                continue
            at = list(starts(len(s)))
            if r:
                z = found[i]
            else:
                z = np.array([value[s[a : a + WIDTH]].max() for a in at])
            picks = {int(z.argmax())} if y[i] else {int(z.argmax()), int(rng.integers(0, len(at)))}
            chosen += [([sample.words[w] for w in s[at[j] : at[j] + WIDTH]], y[i]) for j in picks]
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for lo in range(0, len(order), batch):
                part = [chosen[j] for j in order[lo : lo + batch]]
                step += 1
                for k, g in _step(net, [w for w, _ in part], np.array([v for _, v in part], np.float32)).items():
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.p[k] -= rate / (1 + 0.01 * step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 1200, clean: int = 2400, max_chars: int = 20_000, seed: int = 8) -> Net:
    """A network trained on a bounded sample of the labelled rows (see the module's
    head): rows of `labels` whose crc32(doc_id as text) mod 4 is not 2 and whose toxic
    is 0 or 1. Labels without a document and null ids or texts don't count."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2"
    )
    # at most toxic + clean ids: they are sent to the tasks that read the texts, and no text is shuffled
    ids = reduce(
        DataFrame.unionByName,
        (rows.where(F.col("toxic") == label).distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most) for label, most in ((1, toxic), (0, clean))),
    )
    sample = (
        docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .repartition(1).sortWithinPartitions(F.desc("toxic"), F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    )

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            known += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, known, seed))], pa.binary())], ["net"])

    # the bounded sample is learnt from in one task; only the network comes to the driver
    row = sample.select("text", "toxic").mapInArrow(learn, "net binary").first()
    return pickle.loads(row["net"]) if row else train([], [], seed)


def _scored(batches: Iterable[pa.RecordBatch], net: Net) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
    """Slices of about a million characters, with the scores of their texts."""
    scorer = Scorer(net)
    for batch in batches:
        texts, done, held = batch.column(batch.schema.get_field_index("text")), 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            held += size
            if held > 1_000_000 or i == len(batch) - 1:
                part = batch.slice(done, i + 1 - done)
                yield part, scorer.scores(texts.slice(done, i + 1 - done).to_pylist())
                done, held = i + 1, 0


def keep_clean(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scored(batches, net):
            yield part.filter(pa.array(np.array(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text).

    score is the highest probability of any window of the whole text; null, empty and
    blank texts get the network's `empty` score. held_out: crc32(doc_id as text) mod 4
    is 2 (null id: false). Repeated rows get equal results; other columns are not
    looked at; an empty table gives no rows. The network, a few MB, goes with the tasks.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scored(batches, net):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
