"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers say which characters of the text each token covers. Those are coarse cuts,
for a character may be split over several
tokens, which then name the same character or none. There the decoded bytes of the tokens
tell where each one ends. Byte offsets where tokens of both end cut the text into groups;
tokens of both that share a byte are linked.

Neither tokenizer joins what stands on either side of a single blank or line end between
other characters (the constructor looks that up in the vocabularies), so texts are cut there. A
chunk, a word mostly, is aligned when a task first meets it, many at a time, and what
it gives is kept for the next time: tokens, groups, links. A text is the list of its chunks.

How many documents hold a pair of linked ids is counted in blocks of documents: a block
keeps each of its chunks and pairs once and hands on a row for each different pair. These
rows are summed over the corpus, compared with the highest count of their first id, and go
back to their block, where the sums of each text are read off its list of chunks. So no
row is made for a link of a document, and hot pairs have one row a block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut
from .token_counts import byte_letters

#: Chunks whose alignment a task keeps; letters of a block; chunks, and their letters, aligned at a time; chunks encoded as one text.
MEMO, BLOCK, AT_A_TIME, LETTERS, RUN = 400_000, 32 << 20, 20_000, 1 << 20, 256
#: Where texts are cut.
_CUT = re.compile(r"(?<=[^\s▁])(?=[ \n][^\s▁])")
_SPACE = "▁"


class Aligner:
    """Tokens, groups and links of texts. a_json: text of a byte-level BPE tokenizer's file;
    b_model: bytes of a sentencepiece model with byte fallback."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = {c: b for b, c in enumerate(byte_letters())}
        n = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(i) or "" if c in letters) for i in range(n)]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace(_SPACE, " ").encode() for p, byte in zip(pieces, self.b_is_byte.tolist(), strict=True)]
        self.a_length, self.b_length = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        self.b_space = pieces.index(_SPACE)
        pre, spec = json.loads(a_json)["pre_tokenizer"], json.loads(a_json)
        self.cuts = (
            spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
            and not any(re.search(rf"[^{_SPACE}]{_SPACE}|\n", p) for p in pieces)
        )
        # numbers as they stand in a text of groups, with what follows them
        self.written = {c: np.array([f"{i}{c}" for i in range(max(n, len(pieces)))], object) for c in ",|;"}
        self.written_length = np.array([len(x) for x in self.written[","]])
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks."""
        #: Numbers of chunks by name; of texts that were cut everywhere (-1: not so here), and of those cut with care.
        self.number: dict[str, int] = {}
        self.careful: dict[str, int] = {}
        #: Of each chunk: the text of its groups; tokens of either, groups, links, and whether both decode to it.
        self.texts: list[str] = []
        self.figures = np.zeros((1024, 5), np.int64)
        #: The links of all chunks, one behind the other, and where those of a chunk begin.
        self.codes, self.first = np.zeros(4096, np.int64), np.zeros(1025, np.int64)

    def keep(self, numbers: np.ndarray) -> None:
        """Forgets all chunks but these."""
        new = np.full(len(self.texts), -1)
        new[numbers] = np.arange(len(numbers))
        place, (codes, ends) = new.tolist(), self.links(numbers)
        self.number, self.careful = ({c: place[k] for c, k in d.items() if k >= 0 and place[k] >= 0} for d in (self.number, self.careful))
        self.texts = [self.texts[k] for k in numbers.tolist()]
        self.figures[: len(numbers)] = self.figures[numbers]
        self.first[: len(numbers) + 1] = ends
        self.codes[: len(codes)] = codes

    def cut(self, text: str) -> list[str]:
        """A blank and the text, cut. A chunk that begins with a single blank is named without it."""
        if not self.cuts:
            return [" " + text if text[0] in " \n" else text]
        return [c[1:] if c[0] == " " and c[1:2] not in (" ", "\n", "") else c for c in _CUT.split(" " + text)]

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of each text (not empty), by number; none if the text does not come back from both
        tokenizers. Chunks that are new are aligned first."""
        # mostly, texts are cut at all blanks and line ends; that is wrong where a part shows other blanks beside them
        number, careful = self.number, self.careful
        parts = [t.replace("\n", " \n").split(" ") for t in texts] if self.cuts else [[""] for _ in texts]
        new = set().union(*parts).difference(number)
        odd = {c for c in new if _odd(c)}
        number.update(dict.fromkeys(odd, -1))
        self._learn(new - odd, number, RUN)
        out = [_found(number, p) for p in parts]
        again = {i: self.cut(texts[i]) for i, x in enumerate(out) if x.min() < 0}
        self._learn(set().union(*again.values()).difference(careful), careful, 1)
        for i, p in again.items():
            out[i] = _found(careful, p)
        return [x if self.figures[x, 4].all() else x[:0] for x in out]

    def _learn(self, names: Iterable[str], into: dict[str, int], run: int) -> None:
        new, lo = sorted(names), 0
        while lo < len(new):
            hi, size = lo, 0
            while hi < len(new) and hi - lo < AT_A_TIME and (size := size + len(new[hi])) <= LETTERS:
                hi += 1
            hi = max(hi, lo + 1)
            self._align(new[lo:hi], into, run)
            lo = hi

    def _align(self, names: list[str], into: dict[str, int], run: int) -> None:
        """Encodes chunks, `run` of them as one text, and keeps what they give."""
        chunks = [c if c[0] in " \n" else " " + c for c in names]
        whole = "".join(chunks)
        letters = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF))])  # bytes before each character
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))])  # characters before each chunk
        start = at[first]
        runs = np.append(np.arange(0, len(chunks), run), len(chunks))
        begins = first[runs].tolist()
        texts = [whole[i:j] for i, j in zip(begins[:-1], begins[1:], strict=True)]
        lead = np.array([t[0] == " " for t in texts])
        # tokens of A: their offsets count characters
        found = self.a.encode_batch(texts, add_special_tokens=False)
        a, a_n = _flat([e.ids for e in found])
        spans = _pairs([e.offsets for e in found]) + np.repeat(first[runs[:-1]], a_n)[:, None]
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)  # the next token begins in the same character
        a_end = np.where(shared, _ends(self.a_length[a], a_n, start[runs]), at[np.minimum(spans[:, 1], first[-1])])
        # tokens of B: they count the characters behind the blank that B puts first
        found = self.b.encode([t[1:] if t[0] == " " else t for t in texts], return_type="offset_mapping", num_threads=1)
        b, b_n = _flat([f["ids"] for f in found])
        spans = _pairs([f["offsets"] for f in found]) + np.repeat(first[runs[:-1]] + lead, b_n)[:, None]
        # before a line end the blank is a token of its own, which is none of the chunk's
        firsts = np.cumsum(b_n) - b_n
        blank = firsts[~lead & (b_n > 0)]
        blank = blank[b[blank] == self.b_space]
        b, spans, b_n = np.delete(b, blank), np.delete(spans, blank, 0), b_n - np.isin(firsts, blank)
        b_end = np.where(self.b_is_byte[b], _ends(self.b_length[b], b_n, start[runs]), at[np.minimum(spans[:, 1], first[-1])])
        # both must decode to the text, and the offsets must agree with it
        encoded = whole.encode("utf-8", "surrogatepass")
        good = np.ones(len(texts), bool)
        for ids, n, end, table, length in ((a, a_n, a_end, self.a_bytes, self.a_length), (b, b_n, b_end, self.b_bytes, self.b_length)):
            if b"".join(map(table.__getitem__, ids.tolist())) == encoded and np.array_equal(np.cumsum(length[ids]), end) and np.isin(start[1:], end).all():
                continue
            if run > 1:
                return self._align(names, into, 1)
            ends, k = np.cumsum(n), 0
            for i, e in enumerate(ends.tolist()):
                own = ids[k:e]
                good[i] &= b"".join(map(table.__getitem__, own.tolist())) == encoded[start[i] : start[i + 1]] and np.array_equal(np.cumsum(length[own]) + start[i], end[k:e])
                k = e
        if not good.all():
            for i in np.flatnonzero(~good).tolist():
                self._keep([names[i]], into, np.zeros((1, 5), np.int64), [""], np.empty(0, np.int64))
            if good.any():
                self._align([c for c, ok in zip(names, good.tolist(), strict=True) if ok], into, 1)
            return None
        a_n, b_n = (np.diff(np.searchsorted(end, start, "right")) for end in (a_end, b_end))
        # groups end where tokens of both do
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        groups = np.searchsorted(ends, start[1:], "right") - np.searchsorted(ends, start[:-1], "right")
        # a token's partners are the run of those that end behind its start and start before its end
        a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
        lo, hi = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        n = hi - lo
        codes = np.repeat(a, n) << 32 | b[_runs(lo, n)]
        owner = np.repeat(np.arange(len(chunks)), a_n)
        links = np.bincount(owner, n, len(chunks)).astype(np.int64)
        # the text of the groups: A's ids, a bar, B's ids, a semicolon, in the order of groups
        group = np.concatenate([np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        ids, group, side = np.concatenate([a, b])[order], group[order], side[order]
        out = self.written[","][ids]
        turn = np.flatnonzero(side[:-1] < side[1:])
        out[turn] = self.written["|"][ids[turn]]
        last = np.append(group[1:] != group[:-1], True)
        out[last] = self.written[";"][ids[last]]
        joined, where = "".join(out.tolist()), np.concatenate([[0], np.cumsum(self.written_length[ids])])[np.concatenate([[0], np.cumsum(a_n + b_n)])].tolist()
        texts = [joined[where[i] : where[i + 1]] for i in range(len(chunks))]
        self._keep(names, into, np.stack([a_n, b_n, groups, links, np.ones(len(chunks), np.int64)], 1), texts, codes)
        return None

    def _keep(self, names: list[str], into: dict[str, int], figures: np.ndarray, texts: list[str], codes: np.ndarray) -> None:
        k, n = len(self.texts), len(names)
        while len(self.figures) < k + n:
            self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        begin = self.first[k]
        while len(self.codes) < begin + len(codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.figures[k : k + n] = figures
        self.first[k + 1 : k + n + 1] = begin + np.cumsum(figures[:, 3])
        self.codes[begin : begin + len(codes)] = codes
        into.update(zip(names, range(k, k + n), strict=True))
        self.texts += texts

    def links(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some chunks, one behind the other, and where those of each begin, with the end."""
        ends = np.concatenate([[0], np.cumsum(self.figures[chunks, 3])])
        return self.codes[_runs(self.first[chunks], self.figures[chunks, 3])], ends


def _found(number: dict[str, int], names: list[str]) -> np.ndarray:
    return np.fromiter(map(number.__getitem__, names), np.int64, len(names))


def _odd(name: str) -> bool:
    """Whether a part that was cut at a blank or line end has another blank at its border."""
    body = name[1:] if name[:1] == "\n" else name
    return not body or body[0].isspace() or body[-1].isspace() or body[0] == _SPACE or body[-1] == _SPACE


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., n[0] of them, then those of first[1] and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _pairs(lists: list[list[tuple[int, int]]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(chain.from_iterable(lists)), np.int64).reshape(-1, 2)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


def _ends(lengths: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where tokens of these lengths end, n of them from each start on."""
    upto = np.concatenate([[0], np.cumsum(lengths)])
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    return upto[1:] + np.repeat(start[:-1] - upto[first], n)


def _squeezed(x: np.ndarray) -> bytes:
    """Rising whole numbers below 2**63, or any below 2**32, as bytes."""
    rising = len(x) > 0 and x[0] >= 0 and bool((np.diff(x) >= 0).all())
    d = np.diff(x, prepend=0) if rising else x
    kind = np.uint16 if d.max(initial=0) < 1 << 16 else np.uint32 if d.max(initial=0) < 1 << 32 else np.uint64
    raw = d.astype(kind).tobytes()
    head = np.array([rising, np.dtype(kind).itemsize, len(raw)], np.int64).tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _restored(b: bytes) -> np.ndarray:
    rising, width, size = np.frombuffer(b[:24], np.int64).tolist()
    d = np.frombuffer(pa.decompress(b[24:], size, codec="zstd", asbytes=True), f"u{width}").astype(np.int64)
    return np.cumsum(d) if rising else d


@cache
def _aligner(a_json: str, b_model: bytes) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
    return Aligner(a_json, b_model)


class _Block:
    """Documents of one block, by their chunks."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.ids, self.chunks, self.size = aligner, [], [], 0

    def rows(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        """A row for each document, and one of the block's chunks and pairs."""
        al, n = self.aligner, len(self.ids)
        used = np.zeros(len(al.texts), bool)
        for c in self.chunks:
            used[c] = True
        known = np.flatnonzero(used)
        local = np.cumsum(used) - 1
        links, ends = al.links(known)
        pairs, of = np.unique(links, return_inverse=True)
        held = np.zeros(len(pairs), np.int64)
        figures, digests, lists, times = np.zeros((n, 4), np.int64), [], [], []
        for i, c in enumerate(self.chunks):
            if not len(c):
                digests.append("")
                lists.append(None)
                times.append(None)
                continue
            figures[i] = al.figures[c, :4].sum(0)
            digests.append(hashlib.sha256("".join(map(al.texts.__getitem__, c.tolist()))[:-1].encode()).hexdigest())
            own, count = np.unique(local[c], return_counts=True)
            held[np.unique(of[_runs(ends[own], ends[own + 1] - ends[own])])] += 1
            lists.append(_squeezed(own))
            times.append(_squeezed(count))
        table = [_squeezed(x) for x in (ends, of, pairs, held)]
        cols = [
            pa.array([number] * (n + 1), pa.int64()), pa.array([*self.ids, None], kind), *[pa.array([*figures[:, k].tolist(), None], pa.int64()) for k in range(4)],
            pa.array([*digests, None], pa.string()), pa.array([*lists, table[0]], pa.binary()), pa.array([*times, table[1]], pa.binary()),
            pa.array([*[None] * n, table[2]], pa.binary()), pa.array([*[None] * n, table[3]], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, _NAMES)


_NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunks", "times", "pairs", "held"]
_ROWS = "block long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary, times binary, pairs binary, held binary"
_OUT = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, a_json: str, b_model: bytes, block_size: int = BLOCK, memo: int = MEMO) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of `docs` (doc_id, text).

    A (a_json: text of a byte-level BPE file) encodes a blank and the text, B (b_model: bytes
    of a sentencepiece file) the text, before which it puts a blank itself. n_groups counts the groups between
    byte offsets where tokens of both end, n_links the pairs of token occurrences whose bytes
    overlap. A pair of ids counts as often as rows of `docs` hold it linked: count_sum sums
    that over the links, n_best counts the links whose pair has the highest count of its A id,
    ties included. groups_sha256 is the hash of the groups' ids, `a1,a2|b1;a3|b2,b3`.

    Texts that are null, empty, or that either tokenizer does not give back byte by byte have no
    tokens: zeros, and an empty groups_sha256. Repeated rows count as rows each. Other columns
    are not looked at. An empty table gives no rows. block_size (letters of a block) and memo (chunks that a
    task keeps) bound memory, and change no result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(a_json, b_model)
        number = TaskContext.get().partitionId() << 32
        block = _Block(al)
        for batch in batches:
            ids, texts, lo = batch.column(0).to_pylist(), batch.column(1), 0
            while lo < len(ids):
                part, size = [], 0
                while lo + len(part) < len(ids) and size < min(LETTERS, block_size):
                    part.append(texts[lo + len(part)].as_py() or "")
                    size += len(part[-1]) + 1
                if block.size and (block.size + size > block_size or len(al.texts) > memo):
                    yield block.rows(number, batch.schema.field(0).type)
                    if len(al.texts) > memo:
                        often = np.flatnonzero(np.bincount(np.concatenate(block.chunks), minlength=len(al.texts)) > 1)
                        al.keep(often[: memo // 2])
                    number, block = number + 1, _Block(al)
                found = iter(al.numbers([t for t in part if t]))
                block.ids += ids[lo : lo + len(part)]
                block.chunks += [next(found) if t else np.empty(0, np.int64) for t in part]
                block.size += size
                lo += len(part)
        if block.ids:
            yield block.rows(number, batch.schema.field(0).type)

    rows = cut(docs.select("doc_id", "text").mapInArrow(blocks, _ROWS.format(kind)))

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, held in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                pairs, held = _restored(pairs), _restored(held)
                for lo in range(0, len(pairs), 100_000):
                    own = pairs[lo : lo + 100_000]
                    at = np.arange(lo, lo + len(own))
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int64()), pa.array(at, pa.int32()), pa.array(own), pa.array(held[lo : lo + 100_000])], ["block", "at", "pair", "held"])

    held = rows.where("pairs is not null").select("block", "pairs", "held").mapInArrow(listed, "block long, at int, pair long, held long")
    # one row for each block that has the pair
    counted = held.select("block", "at", F.shiftright("pair", 32).alias("a"), F.sum("held").over(Window.partitionBy("pair")).alias("n"))
    # as many rows as A has ids, a few tens of thousands
    best = F.broadcast(counted.groupBy("a").agg(F.max("n").alias("most")))
    figures = counted.join(best, "a").select("block", "at", "n", (F.col("n") == F.col("most")).alias("best"))

    def read_off(key: tuple, docs: pa.Table, figures: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        is_table = docs.column("pairs").is_valid().to_numpy()
        table = docs.slice(int(np.flatnonzero(is_table)[0]), 1).to_pylist()[0]
        ends, of = _restored(table["chunks"]), _restored(table["times"])
        sums = np.zeros((2, len(figures)), np.int64)
        at = figures.column("at").to_numpy()
        sums[0, at], sums[1, at] = figures.column("best").to_numpy(), figures.column("n").to_numpy()
        # of each chunk: links that are best, sum of counts
        upto = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(sums[:, of], 1)], 1)
        of_chunk = upto[:, ends[1:]] - upto[:, ends[:-1]]
        docs = docs.filter(pa.array(~is_table))
        got = np.zeros((2, len(docs)), np.int64)
        for i, (c, t) in enumerate(zip(docs.column("chunks").to_pylist(), docs.column("times").to_pylist(), strict=True)):
            if c is not None:
                got[:, i] = of_chunk[:, _restored(c)] @ _restored(t)
        cols = [*[docs.column(c) for c in _NAMES[1:6]], pa.array(got[0]), pa.array(got[1]), docs.column("groups_sha256")]
        return pa.table(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.groupBy("block").cogroup(figures.groupBy("block")).applyInArrow(read_off, _OUT.format(kind))
