"""Language identification with bit-sliced Bloom filters of character trigrams.

Training counts the trigrams of each language over all labelled documents. A trigram
belongs to a language if it makes up at least RATE of that language's trigrams, and at
least SHARE of the rate that it has in the language where it is most frequent; so a
language has at most 1 / RATE trigrams, however large the corpus.

All languages share one filter: a table of M rows of bitmasks, one bit a language. Adding
a trigram sets the language's bit in HASHES rows; looking it up is one AND of HASHES rows, and
returns the mask of all languages that contain the trigram at once. A document's trigrams
are looked up in bulk, and the bits of their masks are counted by language. A language whose
filter has the share f of its bits set answers f ** HASHES of foreign trigrams by mistake;
that is taken off each count before the largest one decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of the filter (2 ** BITS), rows of a trigram, languages of one word.
BITS, HASHES, WORD_BITS = 18, 3, 64
M = 1 << BITS
RATE, SHARE = 2e-5, 0.1
#: Letters taken at a time, and trigrams that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 1 << 20
UNKNOWN = "und"
#: Languages that a model may have.
MOST = 1024
_SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Codes of the trigrams of a text's words in lower case, a border on either side; words
    are runs of letters. Every run has one at least. In pieces that end between words or within one."""
    is_letter, before = _letters(), np.zeros(1, np.int64)
    for lo in range(0, len(text), PIECE):
        x = np.frombuffer(text[lo : lo + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        x = np.concatenate([before, np.where(is_letter[x], x, 0)])
        if lo + PIECE >= len(text):
            x = np.append(x, 0)
        # of borders in a row one stays
        x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]
        before = x[-2:]
        codes = x[:-2] << 42 | x[1:-1] << 21 | x[2:]
        yield codes[x[1:-1] != 0]  # a border stands in the middle of none


def places(codes: np.ndarray) -> list[np.ndarray]:
    """Rows of the filter for each code, one array a hash."""
    out = []
    for seed in _SEEDS:
        h = (codes.view(np.uint64) ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return out


@dataclass(frozen=True)
class Model:
    """languages in the order of bits, most trained documents first; table: M rows of masks
    (one array for each 64 languages); mistakes: share of foreign trigrams that each language's filter holds."""

    languages: list[str]
    table: list[np.ndarray]
    mistakes: np.ndarray

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Trigrams found, by language."""
        at, out = places(codes), []
        for k, table in enumerate(self.table):
            masks = table[at[0]]
            for p in at[1:]:
                masks &= table[p]
            bits = min(WORD_BITS, len(self.languages) - k * WORD_BITS)
            out += [int(np.count_nonzero(masks & np.uint64(1 << b))) for b in range(bits)]
        return np.array(out, np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the share of trigrams that the language holds, corrected."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        n, found = 0, np.zeros(len(self.languages))
        for codes in trigrams(text):
            n += len(codes)
            found += self.counts(codes)
        if not n:
            return UNKNOWN, 0.0
        share = np.clip((found / n - self.mistakes) / (1 - self.mistakes), 0.0, 1.0)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, code, n: how often each trigram stands in the texts of each language, in parts to be summed."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for codes in trigrams(text.as_py()):
                    held.setdefault(lang, []).append(codes)
                    size += len(codes)
                    if size > HELD:
                        yield from out()
                        size = 0
        yield from out()

    return docs.select("lang", "text").mapInArrow(count, "lang string, code long, n long")


def fit(docs: DataFrame) -> Model:
    """A model of all rows of `docs` (lang, text) with a language and a text. Trigram counts stay
    in Spark; what comes to the driver is the filter: M rows at most, of one word for each 64
    languages, and one row a language. More than MOST languages are an error."""
    docs = docs.where("lang is not null and text is not null")
    found = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} languages")
    counts = cut(trigram_counts(docs).groupBy("lang", "code").agg(F.sum("n").alias("n")))
    totals = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")))  # MOST rows at most
    rates = counts.join(totals, "lang").select("lang", "code", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= RATE)
    top = rates.groupBy("code").agg(F.max("rate").alias("top"))
    members = rates.join(top, "code").where(F.col("rate") >= SHARE * F.col("top"))
    languages = [r["lang"] for r in found]
    number = {lang: i for i, lang in enumerate(languages)}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for at in places(batch.column(1).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit // WORD_BITS), pa.array(np.left_shift(np.int64(1), bit % WORD_BITS))], ["place", "word", "mask"])

    sliced = members.select("lang", "code").mapInArrow(rows, "place long, word long, mask long").groupBy("place", "word").agg(F.bit_or("mask").alias("mask"))
    table = [np.zeros(M, np.uint64) for _ in range(-(-len(languages) // WORD_BITS))]
    got = sliced.toArrow()
    place, word, mask = (got.column(c).to_numpy() for c in ("place", "word", "mask"))
    for k, t in enumerate(table):
        t[place[word == k]] = mask[word == k].view(np.uint64)
    full = np.array([np.count_nonzero(table[i // WORD_BITS] & np.uint64(1 << (i % WORD_BITS))) for i in range(len(languages))]) / M
    return Model(languages, table, full**HASHES)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, if not given), which has a text, with lang_pred and
    score; these replace columns of their names.

    A text that is null or has no letter is `und` with score 0, and so is every text if the
    model has seen no language. A text none of whose trigrams is known gets the language with most
    trained documents, with score 0; ties go to the language with more of them, then
    to the first by code point. Whole texts are read, in pieces. Repeated rows give equal rows;
    an empty table gives no rows.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    # the columns travel as one struct, whatever their names are
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *([] if "text" in kept else ["text"]))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of rows

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(0).field("text") if "text" in kept else batch.column(1)
            found = [m.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")
