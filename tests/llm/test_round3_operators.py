"""Alignment, language identification and hard negatives against brute force and held-out rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.llm import alignment, hard_negatives, language_id
from pricelode.llm.queries import public_tokenizer
from pricelode.llm.token_counts import byte_letters

# ---- alignment


@pytest.fixture(scope="module")
def files():
    return Path(public_tokenizer("byte_bpe_50k.json")).read_text(encoding="utf-8"), Path(public_tokenizer("piece_bpe_32k.model")).read_bytes()


def aligned(rows, files):
    """rows: (id, text). The contract, token by token over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(files[0]), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    letter = {c: i for i, c in enumerate(byte_letters())}
    found, held = [], Counter()
    for i, text in rows:
        ta, tb = [], []
        if text:
            ta = [(k, bytes(letter[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
            if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (ta, tb)):
                ta, tb = [], []
        spans = []
        for t in (ta, tb):
            at, own = 0, []
            for k, x in t:
                own.append((k, at, at + len(x)))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, lo = [], 0
        for e in cuts:
            groups.append("|".join(",".join(str(k) for k, s, f in side if lo <= s and f <= e) for side in spans))
            lo = e
        links, first = [], 0
        for k, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            j = first
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((k, spans[1][j][0]))
                j += 1
        held.update(set(links))
        found.append((i, len(ta), len(tb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (k, _), n in held.items():
        most[k] = max(most[k], n)
    return [(i, na, nb, g, len(ln), sum(held[x] == most[x[0]] for x in ln), sum(held[x] for x in ln), sha) for i, na, nb, g, ln, sha in found]


ODD = [
    None, "", " ", "\n", "  ", "a", " a", "a ", "\na", "a\n", "a\n\nb", "a \nb", "a  b", "a\tb\r\nc", "▁", "a ▁b", "a▁ b", "é", "naïve café Ünï", "中文 日本語\n한국어", "🙂🙂 👩‍👩‍👧 x", "𓀀𓀁 𓀂",
    "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll it's 'S", "a b  c", "x\x00y \x1c z", "1234567 8.90, (x)", "…“quoted”—dash", "é ‍ ﻿", "wort" * 3000, "один два\nтри", "ſt ﬁ Å ½", "A\nB\nC D\n E",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def words(n, seed):
    rng = random.Random(seed)
    some = ["the", "theation", "éaux", "Straße", "中文", "🙂", "ing,", "(x)", "don't", "1999", "a"]
    return [rng.choice([" ", "\n", "  ", " \n"] if rng.random() < 0.05 else [" "]).join(rng.choices(some, k=rng.randint(1, 200))) for _ in range(n)]


def test_alignment_equals_whole_texts(spark, files):
    rows = list(enumerate([*ODD, *words(60, 1)]))
    rows += [rows[20], rows[20], (None, "no id")]
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, block string, n_a int").repartition(3)
    out = alignment.align(docs, *files)
    assert out.columns == ["doc_id", *COLUMNS]
    key = lambda r: (r[0] is None, r)
    want = sorted(aligned(rows, files), key=key)
    assert sorted((tuple(r) for r in out.collect()), key=key) == want
    # with many small blocks and a table that is emptied all the time
    assert sorted((tuple(r) for r in alignment.align(docs, *files, 2000, 10).collect()), key=key) == want
    al = alignment.Aligner(*files)
    for _, text in rows:
        if text:
            assert "".join(c if c[0] in " \n" else " " + c for c in al.cut(text)) == " " + text
    assert alignment.align(spark.createDataFrame([], docs.schema), *files).count() == 0


def test_alignment_by_chunks_equals_whole(files):
    """Tokens and links of chunks are those of the text in one."""
    by_chunk, whole = alignment.Aligner(*files), alignment.Aligner(*files)
    whole.cuts = False
    assert by_chunk.cuts
    texts = [t for t in ODD if t] + words(40, 2)
    got = []
    for al in (by_chunk, whole):
        got.append([(al.figures[at, :4].sum(0).tolist(), "".join(al.texts[i] for i in at), al.links(at)[0].tolist()) for at in al.numbers(texts)])
    assert got[0] == got[1]
    # what was cut with more care does not depend on what was met before
    assert [by_chunk.figures[at].sum(0).tolist() for at in by_chunk.numbers(texts[::-1])][::-1] == [by_chunk.figures[at].sum(0).tolist() for at in by_chunk.numbers(texts)]


def test_squeezed():
    for x in ([], [0], [3, 3, 9], [5, 1], [1 << 40, (1 << 40) + 1], list(range(70000)), [0, 1 << 31]):
        x = np.array(x, np.int64)
        assert np.array_equal(alignment._restored(alignment._squeezed(x)), x)


# ---- language identification


def languages(n, seed=3):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "ach"], "cc": ["éa", "oux", "ien", "ça"]}
    for i in range(n):
        lang = rng.choice(list(parts))
        yield i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang


def plain_trigrams(text):
    out, run = [], ""
    for c in text.lower() + "\0":
        if c.isalpha():
            run += c
        elif run:
            run = f"\0{run}\0"
            out += [run[i : i + 3] for i in range(len(run) - 2)]
            run = ""
    return out


def code(t):
    return ord(t[0]) << 42 | ord(t[1]) << 21 | ord(t[2])


def test_trigrams(monkeypatch):
    for text in ["", "a", "  ", "Hello, wörld! 中文 x1y", "a" * 50, "é-è", "🙂", "A\nB"]:
        got = [int(x) for part in language_id.trigrams(text) for x in part]
        assert got == [code(t) for t in plain_trigrams(text)]
        for piece in (1, 2, 3, 7):
            monkeypatch.setattr(language_id, "PIECE", piece)
            assert [int(x) for part in language_id.trigrams(text) for x in part] == got
        monkeypatch.undo()


def test_languages_equal_plain_sets(spark):
    rows = list(languages(300))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 3 <> 1"))
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if i % 3 != 1:
            counts[lang].update(plain_trigrams(text))
    rate = {g: {t: n / sum(c.values()) for t, n in c.items()} for g, c in counts.items()}
    sets = {g: {t for t, r in own.items() if r >= language_id.RATE and r >= language_id.SHARE * max(o.get(t, 0) for o in rate.values())} for g, own in rate.items()}
    assert set(model.languages) == set(sets)
    right = 0
    for r in language_id.identify(docs, model).where("doc_id % 3 = 1").collect():
        grams = plain_trigrams(r["text"])
        share = {g: sum(t in s for t in grams) / len(grams) for g, s in sets.items()}
        assert abs(r["score"] - share[r["lang_pred"]]) < 0.02 and share[r["lang_pred"]] >= max(share.values()) - 0.02
        right += r["lang_pred"] == r["lang"]
    assert right == sum(i % 3 == 1 for i, *_ in rows)


def test_false_positives_are_taken_off():
    """A filter that is nearly full answers much by mistake; corrected counts still tell."""
    rng = np.random.default_rng(1)
    own = [rng.integers(1, 1 << 60, 150_000) for _ in range(2)]
    own[1] = own[1][:5000]
    table = np.zeros(language_id.M, np.uint64)
    for bit, codes in enumerate(own):
        for p in language_id.places(codes):
            np.bitwise_or.at(table, p, np.uint64(1 << bit))
    full = np.array([np.count_nonzero(table & np.uint64(1 << b)) for b in range(2)]) / language_id.M
    model = language_id.Model(["big", "small"], [table], full**language_id.HASHES)
    foreign = rng.integers(1, 1 << 60, 20_000)
    found = model.counts(foreign)
    assert found[0] > 5000  # by mistake
    assert np.all(np.abs(found / len(foreign) - model.mistakes) < 0.02)
    assert np.array_equal(model.counts(own[1][:100])[1:], [100])


def test_language_odd_rows(spark):
    train = spark.createDataFrame(list(languages(60)), "doc_id long, text string, lang string").union(spark.createDataFrame([(900, None, "zz"), (901, "ghost text", None)], "doc_id long, text string, lang string"))
    model = language_id.fit(train)
    assert set(model.languages) == {"aa", "bb", "cc"}
    rows = [(1, None, "x", 1.0), (2, "", "x", 1.0), (3, " 12 !? \n", "x", 1.0), (4, "日本語 текст", "x", 1.0), (5, "kalo mitu", "x", 1.0), (5, "kalo mitu", "x", 1.0), (None, "schung eitach", "x", 1.0), (7, "sch " * 500_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    out = language_id.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in out.collect()}
    assert {1: "und", 2: "und", 3: "und", 4: model.languages[0], 5: "aa", None: "bb", 7: "bb"} == dict(got.keys())
    assert got[1, "und"] == 0 and got[4, model.languages[0]] < 0.01 and got[5, "aa"] > 0.99 and out.count() == len(rows)
    assert language_id.identify(docs.limit(0), model).count() == 0
    none = language_id.fit(train.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, none, ["doc_id"]).collect()} == {"und"}


def test_many_languages(spark):
    """More languages than one word has bits."""
    rows = [(i, " ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26)}q"] * 20), f"l{i:03}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(docs, language_id.fit(docs)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in out)


# ---- hard negatives


def mined(rows, k=5, n=10, low=30, high=90):
    """rows: (id, label, vector, is anchor)."""
    own = {}
    for i, label, v, chosen in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = min(own[i], (label, v, chosen)) if i in own else (label, v, chosen)
    whole = {i: (label, [math.floor(256 * x) for x in v], chosen) for i, (label, v, chosen) in own.items()}
    out = []
    for i, (label, v, chosen) in whole.items():
        if not chosen:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, (other, w, _) in whole.items() if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:k]:
            fit = sorted((t, m) for t, m, other in scored if other != label and low * -s <= -100 * t <= high * -s)[:n]
            out += [(i, j, place + 1, m, -s, -t) for place, (t, m) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("tiny", [False, True])
def test_hard_negatives(spark, monkeypatch, tiny):
    if tiny:  # many blocks
        monkeypatch.setattr(hard_negatives, "BLOCK", 16)
        monkeypatch.setattr(hard_negatives, "SMALLEST", 8)
        monkeypatch.setattr(hard_negatives, "TABLES", 3)
    rng = random.Random(5)
    vector = lambda dim: [rng.gauss(0.1, 0.2) for _ in range(dim)]
    same = vector(12)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), vector(12), i % 9 == 0) for i in range(150)]
    rows += [(i, rng.choice([1, 2]), same, i % 9 == 0) for i in range(150, 200)]  # ties
    rows += [(i, rng.choice([1, 2]), vector(3), i % 2 == 0) for i in range(200, 220)]  # other lengths
    rows += [(i, 1 + i % 2, [], True) for i in range(220, 224)] + [(230, 4, vector(12), True)]  # nothing of its label
    rows += [(9, 2, vector(12), True), rows[0], rows[0]]  # ids that repeat
    rows += [(300, None, vector(12), True), (301, 1, None, True), (302, 1, [1.0, None], True), (303, 1, [float("nan")] * 12, True), (None, 1, vector(12), True), (305, 1, [float("inf")] * 12, False), (306, 1, [-3.5] * 12, True)]
    docs = spark.createDataFrame([(i, label, v, chosen, "x", 0) for i, label, v, chosen in rows], "vec_id long, label int, embedding array<double>, chosen boolean, id string, planes int").repartition(3)
    out = hard_negatives.hard_negatives(docs, F.col("chosen"))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in out.collect()) == mined(rows)
    if not tiny:
        assert hard_negatives.hard_negatives(docs.limit(0), F.col("chosen")).count() == 0
        assert hard_negatives.hard_negatives(docs, F.lit(None).cast("boolean")).count() == 0


def test_planes_and_tables():
    rng = np.random.default_rng(2)
    for dim, low, high in ((1, 0, 1), (8, -1, 1), (13, -300, 300), (64, -(1 << 24), 1 << 24), (5, -1, 0), (7, 0, 255)):
        x, y = rng.integers(low, high, (9, dim)), rng.integers(low, high, (4, dim))
        planes, n = hard_negatives.packed(x)
        assert planes.shape == (9, n, -(-dim // 8)) and np.array_equal(hard_negatives.unpacked(planes, dim), x)
        assert np.array_equal(hard_negatives.scores(y, planes), x @ y.T)
    rows = [hard_negatives.packed(v[None])[0].tobytes() for v in x]
    assert np.array_equal(hard_negatives.unpacked(hard_negatives.aligned(rows, 1), 7), x)


def test_components_beyond_the_limit_are_refused(spark):
    docs = spark.createDataFrame([(100, 1, [1e9]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="is beyond"):
        hard_negatives.hard_negatives(docs, F.col("vec_id") % 100 == 0).collect()


# ---- toxicity, word by word


def plain_toxicity(net, text):
    """The network's score of a text, one word and one number at a time."""
    from pricelode.llm import toxicity as tox

    words = tox.tokens(text)
    if not words:
        return net.empty
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    times = lambda v, m: [sum(a * row[j] for a, row in zip(v, m, strict=True)) for j in range(len(m[0]))]
    hidden = tox.HIDDEN

    def vector(word):
        marked = tox.marked(word)
        own = [k for f, k in net.index.items() for i in range(len(marked)) if marked.startswith(f, i)]
        return [sum(p["E"][k][j] for k in own) / len(own) if own else 0.0 for j in range(tox.DIM)]

    def layer(xs, d):
        h, out = [0.0] * hidden, []
        for x in xs:
            g, u = [a + b for a, b in zip(times(x, p[f"W{d}"]), p[f"B{d}"], strict=True)], times(h, p[f"U{d}"])
            new = []
            for j in range(hidden):
                z, r = sigmoid(g[j] + u[j]), sigmoid(g[hidden + j] + u[hidden + j])
                n = math.tanh(g[2 * hidden + j] + r * u[2 * hidden + j])
                new.append((1 - z) * n + z * h[j])
            h = new
            out.append(h)
        return out

    known, best = {w: vector(w) for w in set(words)}, -math.inf
    for s in tox.starts(len(words)):
        xs = [known[w] for w in words[s : s + tox.WIDTH]]
        states = [f + b for f, b in zip(layer(xs, "f"), layer(xs[::-1], "b")[::-1], strict=True)]
        weights = [math.exp(sum(math.tanh(q + a) * v for q, a, v in zip(times(t, p["A"]), p["a"], p["v"], strict=True))) for t in states]
        pooled = [sum(e * t[j] for e, t in zip(weights, states, strict=True)) / sum(weights) for j in range(2 * hidden)]
        best = max(best, sum(a * b for a, b in zip(pooled, p["w"], strict=True)) + p["c"][0])
    return sigmoid(best)


def test_toxicity_equals_a_plain_forward_pass():
    from pricelode.llm import toxicity as tox

    rng = random.Random(9)
    clean, bad = [f"wort{i}" for i in range(60)], ["widerlich", "abschaum", "ekelhaft"]
    texts, labels = [], []
    for i in range(160):
        words = rng.choices(clean, k=rng.randint(20, 120))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    net = tox.train(texts, labels)
    assert net.p and net.index
    held = ["", None, "wort1", "WIDERLICH!", "abschaum " * 3, " ".join(rng.choices(clean, k=47) + ["ekelhaft"] + rng.choices(clean, k=90)), " ".join(rng.choices(clean, k=200)), "x" * 3000, "abschaumabschaum wort7"]
    got = tox.Scorer(net).scores(held)
    assert all(abs(a - plain_toxicity(net, t)) < 1e-4 for a, t in zip(got, held, strict=True))
    assert got[3] > got[2] and got[5] > got[6]
    # very long texts and repeated ones
    long = " ".join(rng.choices(clean, k=30_000)) + " abschaum"
    assert tox.Scorer(net).scores([long, "wort1", long]) == tox.Scorer(net).scores([long, "wort1", long]) and tox.Scorer(net).scores([long])[0] == pytest.approx(tox.Scorer(net).scores(["wort1", long])[1], abs=1e-5)


# ---- sharding, with the same draws


@pytest.mark.parametrize(("n", "shards"), [(200, 7), (5, 12), (0, 3)])
def test_sharding_deals_as_the_matrix_says(spark, n, shards):
    from pricelode.llm import sharding

    seed = 20
    docs = spark.range(0, n, 1, 3).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), (F.col("id") % 5).cast("string"))).alias("text"), F.lit("x").alias("slot"))
    kept = docs.select("doc_id", "text")
    keyed = kept.select("*", F.spark_partition_id().alias("part"), F.xxhash64(F.lit(seed), F.to_json(F.struct("doc_id", "text"))).alias("key")).collect()
    parts = defaultdict(list)
    for r in keyed:
        parts[r["part"]].append((r["key"], r["doc_id"], r["text"]))
    order = sorted(parts)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    ranked = [(p, rank, row) for p in order for rank, row in enumerate(sorted(parts[p]))]
    draws = {}
    if ranked:
        table = spark.createDataFrame([(p, rank) for p, rank, _ in ranked], "block long, rank long").select("*", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "block", "rank"), 32).alias("draw"))
        draws = {(r["block"], r["rank"]): r["draw"] for r in table.collect()}
    hands = defaultdict(list)
    matrix = dict(zip(order, sharding.communication_matrix([len(parts[p]) for p in order], room, seed), strict=True))
    for p, rank, row in ranked:  # each partition deals its permuted rows to the shards in turn
        shard, upto = 0, matrix[p][0]
        while rank >= upto:
            shard += 1
            upto += matrix[p][shard]
        hands[shard].append((draws[p, rank], p, rank, row))
    want = sorted((row[1], s, slot) for s, hand in hands.items() for slot, (_, _, _, row) in enumerate(sorted(hand)))
    got = sharding.shard_rows(docs, shards, seed)
    assert got.columns == ["doc_id", "text", "shard", "slot"]
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got.collect()) == want


# ---- names and items that earlier operators stumbled over

CLASHING = ["key", "zero", "found", "new", "between", "others", "hash", "gone", "row", "h", "copy", "__key", "__found", "__hash", "__gone", "__mix_hash", "__mix_copy", "place", "d", "r", "p", "g"]


def clashing(spark, rows):
    """Documents (doc_id, text) with a column of each name, whose values tell of the row."""
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "s", *[f"{c}{i}" for c in CLASHING]) for i, t in rows], schema)


def test_columns_of_any_name_stay(spark):
    from pricelode.llm import line_dedup, mixing, pseudonyms

    docs = clashing(spark, [(1, "mail a.b@example.com\nsame line of words"), (2, "same line of words\nother"), (3, None), (4, "")])
    for out, n in ((pseudonyms.pseudonymise(docs, "k"), 4), (line_dedup.dedupe_lines(docs), 4), (mixing.mix_documents(docs, 2.0, (1,)), None)):
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert n is None or len(rows) == n
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)
    new = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(docs, "k").collect()}
    assert new[1] != "mail a.b@example.com\nsame line of words" and new[1].startswith("mail ") and new[3] is None and new[4] == ""
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedupe_lines(docs).collect()}
    assert left[2] == "other"
    only = docs.select("text")
    assert pseudonyms.pseudonymise(only, "k").columns == ["text", "n_replaced"]


def test_items_without_words_and_ids_of_any_type(spark, monkeypatch):
    from pricelode.llm import decontamination

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)]
    texts = [(i, " ".join(word() for _ in range(60)) + (" " + passages[i] if i < 6 else "")) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    silent = spark.createDataFrame([("x", "... !!!", None), ("y", " ", "a"), ("z", None, None), (None, "\n", None)], "item_id string, text string, answer string")
    assert decontamination.leaks(docs, silent).count() == 0 and decontamination.decontaminate(docs, silent).count() == 20
    items = spark.createDataFrame([(f"i{k}", p, None) for k, p in enumerate(passages)], "item_id string, text string, answer string").union(silent)
    for size in (decontamination.ITEM_BYTES, 600):  # in one block, and in three
        monkeypatch.setattr(decontamination, "ITEM_BYTES", size)
        assert len(list(decontamination._blocks(items))) == (1 if size > 600 else 3)
        found = decontamination.leaks(docs, items)
        assert dict(found.dtypes)["item_id"] == "string" and sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k, f"i{k}") for k in range(6)]
        assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()) == list(range(6, 20))
