"""Token counts by a finite-state transducer compiled from a BPE tokenizer.

Byte-pair encoding of a word is a finite-state process: two tokens may follow each other
if merging them by themselves leaves them as they are, and the encoding of a word is the
one sequence of tokens each pair of which may (so are all its beginnings). The transducer
reads a word byte by byte. Its state holds the places at which a token may still be open:
for each the piece of it that was read, the token before it, and the tokens emitted up to
there. Each transition leads to one state and carries the number of tokens that are now
settled; the transition over the last byte of a word carries the rest. States and
transitions are compiled from the merges when they are first met, into tables of numbers;
a word's path through the tables is kept as one transition of its own.

Blanks lead back to the start state. So a text is cut into chunks of CHUNK characters
anywhere. What a chunk does to whatever state it is entered in (its state map) has a short
form: the text before its first blank completes the word that has begun, the words between
the blanks emit a fixed number of tokens, and the text behind the last blank is the begun
word (its bytes, as lower case and accents may still change it). These maps compose
associatively, so chunks are counted on their own and put together by a prefix scan; long
texts are spread over tasks, and only maps are shuffled.

Counts equal those of the library for a file of this kind: normalizer NFC, blanks,
lower case; a splitting pattern without blanks; byte-level BPE with a word-end suffix.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Words and pieces of words whose counts a task keeps, and transitions.
MEMO, TRANSITIONS = 500_000, 2_000_000
#: Bits of a symbol: a byte, and whether it ends the word.
SYMBOL = 9


WORD_END = "</w>"


@dataclass(frozen=True)
class StateMap:
    """head, tail: bytes before the first and behind the last blank; tokens: of the
    words between. Without any blank, `open`: head is all of it."""

    open: bool
    head: bytes
    tokens: int
    tail: bytes


class Machine:
    """The transducer for one word: its states, and transitions with emitted tokens."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {m: i for i, m in enumerate(merges)}
        code = {c: b for b, c in enumerate(byte_letters())}
        self.spelling = {c + end: [b + (256 if end else 0)] for c, b in code.items() for end in ("", WORD_END)}
        for a, b in merges:
            self.spelling[a + b] = self.spelling[a] + self.spelling[b]
        self.tokens = list(self.spelling)
        # a tree of all tokens: (node, symbol) -> node; the token that ends at a node, or -1
        self.tree: dict[int, int] = {}
        self.ends, self.inner = [-1], [True]
        for t, token in enumerate(self.tokens):
            node = 0
            for s in self.spelling[token]:
                self.inner[node] = True
                key, node = node << SYMBOL | s, self.tree.get(node << SYMBOL | s, -1)
                if node < 0:
                    node = self.tree[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = t
        self.letter = {codes[0]: c for c, codes in self.spelling.items() if len(codes) == 1}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets all states but the first one and all transitions."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int]] = {}

    def follows(self, before: int, token: int) -> bool:
        """Whether a token may stand behind another, or (-1) at the beginning."""
        ok = self.pairs.get((before, token))
        if ok is None:
            own = [token] if before < 0 else [before, token]
            symbols = [self.letter[s] for t in own for s in self.spelling[self.tokens[t]]]
            ok = self.pairs[before, token] = merged(symbols, self.rank) == [self.tokens[t] for t in own]
        return ok

    def compiled(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition from a state over a symbol: next state, tokens emitted."""
        opened, settled = [], None
        for node, before, n in self.states[state]:
            to = self.tree.get(node << SYMBOL | symbol)
            if to is None:
                continue
            t = self.ends[to]
            if settled is None and t >= 0 and self.follows(before, t):
                settled = (0, t, n + 1)
            if self.inner[to]:
                opened.append((to, before, n))
        if symbol >= 256:
            return 0, settled[2]
        opened.append(settled)
        least = min(n for _, _, n in opened)
        new = tuple((node, before, n - least) for node, before, n in opened)
        if (k := self.number.setdefault(new, len(self.states))) == len(self.states):
            self.states.append(new)
        return k, least

    def count(self, word: bytes) -> int:
        """Tokens of a word (not empty)."""
        if len(self.table) > TRANSITIONS:
            self.clear()
        state, total, last = 0, 0, len(word) - 1
        for i, b in enumerate(word):
            symbol = b if i < last else b | 256
            step = self.table.get(state << SYMBOL | symbol)
            if step is None:
                step = self.table[state << SYMBOL | symbol] = self.compiled(state, symbol)
            state, n = step
            total += n
        return total


class Transducer(dict):
    """Word (bytes without ASCII blanks) -> number of tokens that it emits."""

    def __init__(self, tokenizer_json: str):
        super().__init__()
        spec = json.loads(tokenizer_json)
        model, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [n["type"] for n in norm["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this transducer is for byte-level BPE with word ends, NFC and lower case")
        self.machine = Machine([tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        self.pieces = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.counted: dict[str, int] = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        n = 0
        for k, part in enumerate(self.special.split(word.decode("utf-8", "surrogatepass"))):
            if k % 2:
                n += 1
            elif part:
                # each character is put in lower case by itself: sigma has one form
                norm = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                n += sum(map(self._piece, self.pieces.findall(norm)))
        self[word] = n
        return n

    def _piece(self, piece: str) -> int:
        n = self.counted.get(piece)
        if n is None:
            if len(self.counted) > MEMO:
                self.counted.clear()
            n = self.counted[piece] = self.machine.count(piece.encode("utf-8", "surrogatepass"))
        return n

    def words(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))

    def state_map(self, chunk: bytes) -> StateMap:
        parts = chunk.split(None, 1)
        first = len(parts[0]) if parts else 0
        if not chunk or (first == len(chunk)):
            return StateMap(True, chunk, 0, b"")
        head = parts[0] if parts and chunk.startswith(parts[0]) else b""
        last = chunk.rsplit(None, 1)[-1] if parts else b""
        tail = last if last and chunk.endswith(last) else b""
        return StateMap(False, head, self.words(chunk[len(head) : len(chunk) - len(tail)]), tail)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b."""
        if a.open and b.open:
            return StateMap(True, a.head + b.head, 0, b"")
        if a.open:
            return StateMap(False, a.head + b.head, b.tokens, b.tail)
        if b.open:
            return StateMap(False, a.head, a.tokens, a.tail + b.head)
        return StateMap(False, a.head, a.tokens + self.words(a.tail + b.head) + b.tokens, b.tail)

    def total(self, m: StateMap) -> int:
        """Tokens of a whole text with this map."""
        return self.words(m.head) + m.tokens + self.words(m.tail)


def scan(maps: list[StateMap], compose) -> list[StateMap]:
    """The compositions of all prefixes, in log2(n) rounds."""
    out, step = list(maps), 1
    while step < len(out):
        out = [compose(out[i - step], m) if i >= step else m for i, m in enumerate(out)]
        step *= 2
    return out


def merged(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """What is left when the pair of lowest rank, leftmost first, is merged until none has a rank."""
    none = len(rank)
    while len(symbols) > 1:
        ranks = [rank.get(p, none) for p in zip(symbols, symbols[1:])]  # noqa: B905
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def byte_letters() -> list[str]:
    """The usual letters for the 256 bytes: printable ones stand for themselves, the
    rest follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@cache
def _transducer(tokenizer_json: str) -> Transducer:
    return Transducer(tokenizer_json)


_MAP = "doc_id {}, hash long, n_bytes long, at int, open boolean, head binary, tokens long, tail binary"


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of
    `docs` (doc_id, text). tokenizer_json: the text of the tokenizer's file, a few MB.

    A null text counts as empty: no bytes, no tokens. Repeated rows give equal rows.
    Other columns are not looked at. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    # one pass over a text cuts all its chunks, and each row takes only its own
    parts = F.when(F.length("text") <= CHUNK, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    chunks = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"), F.posexplode(parts).alias("at", "chunk")
    )

    def map_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(tokenizer_json)
        for batch in batches:
            maps = [t.state_map(c.as_py().encode("utf-8", "surrogatepass")) for c in batch.column(4)]
            cols = [pa.array([getattr(m, f) for m in maps], k) for f, k in (("open", pa.bool_()), ("head", pa.binary()), ("tokens", pa.int64()), ("tail", pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], ["doc_id", "hash", "n_bytes", "at", "open", "head", "tokens", "tail"])

    def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(tokenizer_json)
        for batch in batches:
            totals = []
            for maps in batch.column(3).to_pylist():
                ordered = [StateMap(m["open"], m["head"], m["tokens"], m["tail"]) for m in sorted(maps, key=lambda m: m["at"])]
                totals.append(t.total(scan(ordered, t.compose)[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "copies", "n_tokens"])

    # equal rows have equal maps: a set keeps one of each, and the copies are counted
    texts = (
        chunks.mapInArrow(map_chunks, _MAP.format(kind))
        .groupBy("doc_id", "hash", "n_bytes")
        .agg(F.count(F.when(F.col("at") == 0, 1)).alias("copies"), F.collect_set(F.struct("at", "open", "head", "tokens", "tail")).alias("maps"))
        .select("doc_id", "n_bytes", "copies", "maps")
    )
    return (
        texts.mapInArrow(put_together, f"doc_id {kind}, n_bytes long, copies long, n_tokens long")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
