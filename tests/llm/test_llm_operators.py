"""Operators against brute force on small tables with nulls, empty texts, ties,
repeated rows and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.llm import decontamination, embeddings, lattice, line_dedup, minhash, mixing, pseudonyms, sharding, token_counts, toxicity
from pricelode.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, slot int, h int, node int"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def corpus(n=60, seed=1):
    random.seed(seed)
    w = ["alpha", "Beta", "gamma", "delta,", "eps", "zeta", "eta.", "theta", "iota", "kappa"]
    texts = [" ".join(random.choices(w, k=random.randint(1, 60))) for _ in range(n)]
    for i in range(0, n - 6, 6):  # exact and near copies
        texts[i + 1] = texts[i]
        x = texts[i].split()
        texts[i + 2] = " ".join([*x[:-1], "changed"]) if len(x) > 30 else texts[i + 2]
    texts += [None, "", "  \n ", "one", "a" * 5000, "straße É 中文 " * 50]
    rows = [(i, t, "en", [None, "b", "a", "é"][i % 4], 0, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().translate(LOWER).split()


def test_sharding(docs, none):
    out = sharding.shard_digest(docs, 7).collect()
    assert len(out) == docs.count()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.shard_digest(none).count() == 0


def test_matrix_is_uniform():
    rng, counts = random.Random(3), Counter()
    for _ in range(20000):
        counts[sharding.hypergeometric(rng, 10, 4, 5)] += 1
    for k in range(5):
        p = math.comb(4, k) * math.comb(6, 5 - k) / math.comb(10, 5)
        assert abs(counts[k] / 20000 - p) < 0.015
    rows = list(sharding.communication_matrix([5, 0, 9], [4, 5, 5], 1))
    assert [sum(r) for r in rows] == [5, 0, 9] and [sum(c) for c in zip(*rows)] == [4, 5, 5]  # noqa: B905


def filled_targets(sizes, weights, budget, most):
    room, full = {k: most * v for k, v in sizes.items()}, set()
    while True:
        left = budget - sum(room[k] for k in full)
        w = sum(weights[k] for k in sizes if k not in full)
        level = {k: left * weights[k] / w for k in sizes if k not in full}
        over = {k for k, v in level.items() if v > room[k]}
        if not over:
            return {k: room[k] if k in full else level[k] for k in sizes}
        full |= over


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    source, size = {}, Counter()
    for i, t, _, s, *_ in corpus():
        source[i] = s
        size[s] += len(tokens(t))
    order = sorted([s for s in size if s is not None]) + [None]
    want = filled_targets(dict(size), {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()), 2.0)
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix_documents(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.mix_documents(docs).columns == docs.columns and mixing.mix(none).count() == 0


def test_budgets_are_nested(docs):
    small, large = ({(r["doc_id"], r["copies"]) for r in mixing.mix(docs, share=s, weights=(1,), fills=0).collect()} for s in (0.3, 0.8))
    by = dict(large)
    assert all(by[i] >= c for i, c in small)


def test_full_sources_take_no_third_copy(spark):
    rows = [(i, "a" if i < 40 else "b", "w " * 5 if i < 20 else "" if i < 40 else "w " * 60) for i in range(60)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert all(0 <= r["copies"] <= 2 for r in out) and {r["copies"] for r in out if r["doc_id"] < 40} == {2}


def shingles(text, k):
    w = tokens(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_minhash(docs, none):
    sets = {i: shingles(t, 4) for i, t, *_ in corpus()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    out = minhash.near_duplicates(docs, 4).collect()
    assert len(out) == docs.count()
    assert all(r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]]) for r in out)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    kept = minhash.drop_near_duplicates(docs, 4)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert minhash.near_duplicates(none).count() == 0


def test_near_copies_without_one_head(spark):
    """A chain of texts, each near the next only, and one large group around no member."""
    random.seed(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(30):
        x = list(base)
        for j in random.sample(range(60), 2):
            x[j] = f"n{k}-{j}"
        rows.append((k, " ".join(x)))
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert out == want


def test_torn_buckets_have_a_row_a_component(spark):
    # key 1: components 10 (five classes) and 20; key 2: one component; key 3: two classes, compared already
    rows = [(1, 10, 10 + i) for i in range(5)] + [(1, 20, 20)] + [(2, 10, 10 + i) for i in range(5)] + [(3, 10, 10), (3, 20, 20)]
    df = spark.createDataFrame(rows, "key long, component long, node long")
    out = minhash._torn(df.select("key", "component", F.lit(1).alias("n"), F.array_repeat("node", minhash.TURNS).alias("heads"))).collect()
    assert sorted((r["key"], r["component"], r["n"]) for r in out) == [(1, 10, 5), (1, 20, 1)]
    assert all(r["main"]["component"] == 10 and 10 <= h < 15 for r in out for h in r["main"]["heads"])


def test_one_id_with_two_texts(spark):
    random.seed(7)
    text = lambda: [f"w{random.randint(0, 999)}" for _ in range(40)]
    a, b = text(), text()
    changed = lambda x: " ".join([*x[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, changed(a)), (3, changed(b)), (None, changed(b)), (None, "only here"), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert out == Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, 1, False): 1, (None, None, True): 2, (4, 4, True): 1})
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in minhash.drop_near_duplicates(df).collect()) == sorted((i or 0, t or "") for i, t in rows if i not in (2, 3))


def test_components(spark):
    random.seed(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(random.randint(0, 90), random.randint(0, 90)) for _ in range(50)] + [(7, 7)]
    want = components({x for e in links for x in e}, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(want[n] == c for n, c in got.items()) and {n for a, b in links if a != b for n in (a, b)} == set(got)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    v = [*base, *(base[i % 12] + 0.05 * rng.standard_normal(16) for i in range(40)), base[0], 3 * base[0]]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None, 1.0], 0), (204, [], 0), (205, [1.0], 0)]
    x = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    near = x @ x.T >= 0.95
    want = components(range(len(v)), list(zip(*np.nonzero(np.triu(near, 1)), strict=True)))
    out = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(out) == len(rows)
    for i in range(len(v)):
        assert (out[i]["n_links"], out[i]["component_id"]) == (near[i].sum() - 1, want[i])
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(200, 206))


def test_embeddings_find_all_links(spark):
    """Thousands of vectors, pairs on either side of the limit: every link, against brute force."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1200, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = rng.standard_normal((1200, 32))
    aside -= (aside * base).sum(1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    cosine = rng.uniform(0.93, 0.99, 1200)[:, None]
    x = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * aside, base[:300] * 2, rng.standard_normal((800, 32))))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    want = components(range(len(x)), list(zip(*np.nonzero(np.triu(near, 1)), strict=True)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in embeddings.near_vectors(rows).collect()}
    links = near.sum(1) - 1
    assert links.sum() > 2000
    # none too many, and of those there are nine in ten at least
    assert all(out[i]["n_links"] <= links[i] for i in out)
    assert sum(r["n_links"] for r in out.values()) >= 0.9 * links.sum()
    assert sum(out[i]["component_id"] == want[i] for i in out) >= 0.9 * len(x)


def test_windows_on_sorted_lines():
    plan = embeddings.Plan(1000, 0.95)
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((20, embeddings.LINES)).astype(np.float32), rng.standard_normal((30, embeddings.LINES)).astype(np.float32)
    plan.least = 20
    want = (np.abs(x[:, None] - y[None]) <= embeddings.WINDOW).sum(2) >= 20
    assert (plan.near(x, y) == want).all()


def test_lattice_sums_all_segmentations():
    pieces = [("▁a", -1.0), ("b", -2.0), ("ab", -3.0), ("▁ab", -4.0), ("a", -5.0), ("▁", -6.0)]
    lat = lattice.Lattice(pieces)
    p = lat.prior()
    logp = np.log(p)

    def total(s):
        if not s:
            return 1.0
        spelled = np.prod([p[lat.byte0 + b] for b in s[0].encode()]) * total(s[1:]) if s[0] not in lat.number else 0.0
        return spelled + sum(p[k] * total(s[len(t) :]) for t, k in lat.number.items() if s.startswith(t))

    texts = ["▁ab", "▁abab", "▁aéb", "▁"]
    soft = np.zeros(len(p))
    got = lat.forward(texts, logp, np.ones(4), soft)
    assert np.allclose(np.exp(got), [total(t) for t in texts])
    assert p.sum() == pytest.approx(1) and soft.sum() > 4


def test_lattice_scores(docs, none):
    out = lattice.lattice_scores(docs, [("▁", -1.0), ("▁al", -2.0), ("pha", -3.0), ("a", -4.0), ("e", -5.0)]).collect()
    rows = corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    for i, t, *_ in rows:
        if not held(i):
            c.update([*tokens(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = [*tokens(t), None]
        want[(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lattice.lattice_scores(none, [("a", 0.0)]).count() == 0


def test_lattice_document_scores(spark):
    """The whole model by listing all segmentations: two rounds of expected counts, then scores."""
    pieces = [("▁", -1.0), ("▁al", -2.0), ("pha", -3.0), ("a", -4.0), ("e", -5.0), ("▁b", -6.0), ("et", -7.0), ("ta", -8.0), ("l", -9.0), ("ph", -10.0), ("t", -11.0)]
    rows = [(1, "alpha beta"), (2, "Beta betal alpha alpha"), (3, None), (4, "xé tal"), (5, "")]
    lat = lattice.Lattice(pieces)
    p = prior = lat.prior()

    def paths(s):
        if not s:
            return [[]]
        out = [[k, *rest] for piece, k in lat.number.items() if s.startswith(piece) for rest in paths(s[len(piece) :])]
        if s[0] not in lat.number:
            out += [[*(lat.byte0 + b for b in s[0].encode()), *rest] for rest in paths(s[1:])]
        return out

    words = Counter(w.lower() for _, t in rows for w in (t or "").split())
    all_paths = {w: paths("▁" + w) for w in words}
    for _ in range(2):
        soft = prior * lattice.PRIOR
        soft[lat.end] += len(rows)
        for w, n in words.items():
            weight = np.array([np.prod(p[x]) for x in all_paths[w]])
            for x, share in zip(all_paths[w], weight / weight.sum(), strict=True):
                np.add.at(soft, x, n * share)
        p = soft / soft.sum()
    word = {w: math.log10(sum(np.prod(p[x]) for x in all_paths[w])) for w in words}
    want = {i: sum(word[w.lower()] for w in (t or "").split()) + math.log10(p[lat.end]) for i, t in rows}
    got = {r["doc_id"]: r["score"] for r in lattice.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string"), pieces, train="true").collect()}
    assert got == pytest.approx(want)


def test_lattice_equal_partitions(spark):
    pieces = [("▁", -1.0), ("▁al", -2.0), ("pha", -3.0), ("a", -4.0), ("e", -5.0)]
    one = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (None, "")], "doc_id long, text string").coalesce(1)
    want = Counter(tuple(r)[:4] for r in lattice.lattice_scores(one, pieces).collect())
    got = lattice.lattice_scores(one.union(one), pieces).collect()
    assert Counter(tuple(r)[:3] for r in got) == Counter({k[:3]: 2 * n for k, n in want.items()})
    rows = spark.sparkContext.parallelize([(7, "alpha beta")] * 3, 3).toDF("doc_id long, text string")
    got = lattice.lattice_scores(rows, pieces, train="true").collect()
    assert len(got) == 3 and len(set(got)) == 1 and got[0]["n_known"] == 3


def test_pseudonyms(spark, docs, none):
    texts = ["4111 1111 1111 1111 and 4111111111111111 not 4111111111111112", "1999-12-31 31.02.2000", "70.1.2.3 999.1.2.3", "DE89370400440532013000", "x", None]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_replaced int")
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(df, "key").collect()}
    a, b, c = (out[0]["text"].split(" and ")[0], *out[0]["text"].split(" and ")[1].split(" not "))
    assert a.replace(" ", "") == b != "4111111111111111" and c == "4111111111111112" and len(a) == 19
    digits = [int(x) for x in reversed(b)]
    assert sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(digits)) % 10 == 0
    assert out[1]["text"].endswith(" 31.02.2000") and out[1]["n_replaced"] == 1
    assert all(0 <= int(x) < 256 for x in out[2]["text"].split()[0].split(".")) and out[2]["n_replaced"] == 1
    iban = out[3]["text"]
    assert iban.startswith("DE") and int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert (out[4]["text"], out[5]["text"], out[4]["n_replaced"]) == ("x", None, 0)
    # texts without numbers stay as they are
    plain = {(r["doc_id"], r["text"]) for r in docs.collect()}
    out = pseudonyms.pseudonymise(docs, "k")
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == plain and out.columns == [*docs.columns, "n_replaced"]
    assert pseudonyms.pseudonymise(none, "k").count() == 0
    assert "secret" not in pseudonyms.pseudonymise(docs, "secret")._jdf.queryExecution().toString()


def test_cards_beside_other_digits(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27", "4111111111111111 123", f"2 {card}", f"{card} 123", "3782 822463 10005", card.replace(" ", "-")]
    out = [r["text"] for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    new = out[0][:-6]
    assert new != card and out[0] == f"{new} 12/27" and out[1] == f"{new.replace(' ', '')} 123" and out[2] == f"2 {new}" and out[3] == f"{new} 123"
    assert out[4] != texts[4] and [len(x) for x in out[4].split()] == [4, 6, 5] and out[5] == new.replace(" ", "-")


def test_phones_however_written(spark):
    texts = ["+49 30 12345678", "+493012345678", "+49-30-1234-5678", "+1 (212) 555-0123", "+12125550123", "+353 86 123 4567", "+353861234567"]
    out = [r["text"] for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    flat = ["".join(c for c in x if c in "+0123456789") for x in out]
    assert flat[0] == flat[1] == flat[2] != "+493012345678" and flat[3] == flat[4] != "+12125550123" and flat[5] == flat[6] != "+353861234567"
    assert flat[0].startswith("+49") and flat[3].startswith("+1") and flat[5].startswith("+353") and [len(x) for x in out] == [len(x) for x in texts]


def feistel(text, key, kind):
    """The network in plain Python."""
    start = [48 if "0" <= c <= "9" else 97 if "a" <= c <= "z" else 65 if "A" <= c <= "Z" else None for c in text]
    radix = [1 if s is None else 10 if s == 48 else 26 for s in start]
    v = [0 if s is None else ord(c) - s for c, s in zip(text, start, strict=True)]
    half = len(text) // 2
    a, b = v[:half], v[half:]
    for r in range(pseudonyms.ROUNDS):
        own, other, base = (a, b, 0) if r % 2 == 0 else (b, a, half)
        seen = hashlib.sha256("|".join([key, kind, str(r), ",".join(map(str, other))]).encode()).hexdigest()
        new = [(x + int(seen[i * 4 % 60 : i * 4 % 60 + 4], 16)) % radix[base + i] for i, x in enumerate(own)]
        a, b = (new, b) if r % 2 == 0 else (a, new)
    return "".join(c if s is None else chr(s + x) for c, s, x in zip(text, start, [*a, *b], strict=True))


def test_network_against_plain_python(spark):
    random.seed(8)
    texts = ["".join(random.choices("0123456789abcXYZ-. ", k=random.randint(2, 30))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pseudonyms.permuted(F.col("t"), F.lit("k1"), "kind").alias("p")).collect()
    assert all(r["p"] == feistel(r["t"], "k1", "kind") for r in got)
    # a card: the network on all digits but the last, then the check digit
    card = pseudonyms.pseudonymise(spark.createDataFrame([("4111111111111111",)], "text string"), "k1").first()["text"]
    assert card[:-1] == feistel("411111111111111", "k1", "card")
    ssn, want = pseudonyms.pseudonymise(spark.createDataFrame([("123-45-6789",)], "text string"), "k1").first()["text"], "123-45-6789"
    while True:
        want = feistel(want, "k1", "ssn")
        if want[:3] not in ("000", "666") and want[0] != "9" and want[4:6] != "00" and want[7:] != "0000":
            break
    assert ssn == want


def test_ibans_with_letters(spark):
    ibans = ["GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S", "BE68 5390 0754 7034"]
    rows = list(enumerate([*(f"to {x} AND 12" for x in ibans), "to GB82 WEST 1234 5698 7654 33 AND 12"]))
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    for i, x in enumerate(ibans):
        new = out[i]["text"][3:-7]
        assert out[i]["n_replaced"] == 1 and new != x and len(new) == len(x) and new[:2] == x[:2]
        assert all((a.isdigit(), a.isalpha()) == (b.isdigit(), b.isalpha()) for a, b in zip(new, x, strict=True))
        flat = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert out[5]["text"] == rows[5][1] and out[5]["n_replaced"] == 0


def test_pseudonyms_are_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    assert df.select(pseudonyms.permuted(F.col("t"), F.lit("k"), "x").alias("p")).distinct().count() == 1000
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pseudonyms.pseudonym(F.col("d"), F.lit("k")).alias("p")).distinct().count() == 3000


def test_line_dedup(spark, none):
    random.seed(4)
    w = ["a", "b", "c", "d", "e", "f"]
    base = [" ".join(random.choices(w, k=random.choice([1, 2, 3, 4, 4, 5, 6, 7, 8, 12]))) for _ in range(20)]

    def edited(x):
        x = x.split()
        k, at = random.choice("ird"), random.randrange(len(x))
        x[at : at + (k != "i")] = [] if k == "d" else ["new"]
        return " ".join(x)

    texts = ["\n".join(random.choice([random.choice(base), edited(random.choice(base)), "", "short one"]) for _ in range(4)) for _ in range(25)] + [None, "", "\n"]
    first = {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if line.split():
                first.setdefault(tuple(line.split()), (i, k))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < line_dedup.SHARE:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1  # noqa: B905
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    lines = list(first)
    part = components(range(len(lines)), [(i, j) for i in range(len(lines)) for j in range(i) if near(lines[i], lines[j])])
    best = {}
    for i, line in enumerate(lines):
        best[part[i]] = min(best.get(part[i], first[line]), first[line])
    keep = {line: best[part[i]] for i, line in enumerate(lines)}
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedupe_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.split() or keep[tuple(x.split())] == (i, k))
        assert out[i] == want
    assert line_dedup.dedupe_lines(none).count() == 0


def test_line_dedup_of_odd_rows(spark):
    """Null ids, repeated rows, columns with the names of results and of what lies between."""
    rows = [(None, "one two three four\none two three five\nx", 7, "a", 1), (1, "x\n\none two three four", 7, "b", 1), (1, "x\n\none two three four", 7, "b", 1), (2, "y " * 5000 + "\nx", 0, None, None)]
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed int, place string, gone int")).collect()
    want = [(None, "one two three four\nx", "a", 1, 3, 1), (1, "", "b", 1, 3, 2), (1, "", "b", 1, 3, 2), (2, "y " * 5000, None, None, 2, 1)]
    assert sorted(((r["doc_id"], r["text"], r["place"], r["gone"], r["n_lines"], r["n_removed"]) for r in out), key=lambda r: (r[0] or 0)) == want


def test_decontamination(spark, docs, none):
    random.seed(9)
    word = lambda: "".join(random.choices("bcdfgaeiou", k=6))
    items = [(i, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(5)]
    noise = lambda n: " ".join(word() for _ in range(n))
    loose = items[2][1].split()
    loose = " ".join(x if k % 7 else word() for k, x in enumerate(loose))
    rows = [(0, noise(300)), (1, f"{noise(150)} {items[1][1].upper()} {noise(90)}"), (2, f"{noise(40)} {loose} {noise(5)}"), (3, None), (4, ""), (5, items[0][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()) == [(1, 1), (2, 2), (5, 0)]
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(d, b).collect()) == [0, 3, 4]
    assert decontamination.decontaminate(docs, b.limit(0)).count() == docs.count()
    assert decontamination.leaks(none, b).count() == 0


def test_decontamination_of_frequent_items(spark):
    """A third of all rows hold one item: its words are common ones."""
    random.seed(11)
    word = lambda: "".join(random.choices("bcdfgaeiou", k=6))
    items = [(i, " ".join(word() for _ in range(28))) for i in range(4)]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, items[1][1] if i % 6 == 0 else f"{noise(40)} {items[1][1]} {noise(30)}" if i % 3 == 0 else noise(50)) for i in range(180)]
    rows.append((500, f"{noise(30)} {items[2][1]} {noise(30)}"))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [(i, 1) for i in range(0, 180, 3)] + [(500, 2)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()) == want
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(d, b).collect()) == [i for i in range(180) if i % 3]


def test_decontamination_of_short_and_long_items(spark):
    random.seed(12)
    vocabulary = ["".join(random.choices("bcdfgaeiou", k=6)) for _ in range(3000)]
    noise = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(n, noise(n)) for n in (1, 3, 5, 300, 1000, 3000)]
    rows = [(n, f"{noise(700)} {x} {noise(500)}") for n, x in items]
    loose = " ".join(x if k % 8 else "other" for k, x in enumerate(items[-1][1].split()))
    rows += [(4000, f"{noise(400)} {loose} {noise(90)}"), (4001, items[-1][1]), (4002, noise(2000))]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()}
    assert {(i, k) for i, k in got if k > 1} == {(3, 3), (5, 5), (300, 300), (1000, 1000), (3000, 3000), (4000, 3000), (4001, 3000)}
    single = items[0][1]
    assert {i for i, k in got if k == 1} == {i for i, t in rows if single in t.split()}


def test_decontamination_finds_paraphrases(spark):
    """Items with a part of their words replaced, gone or added, against a comparison of
    every document's windows with its item: at least nine in ten are found, and nothing else."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(4000)]
    noise = lambda n: rng.choices(vocabulary, k=n)
    items = {i: f"{' '.join(noise(n))}. {' '.join(noise(9))}." for i, n in enumerate((12, 20, 31, 45, 60, 90, 140, 250, 420))}

    def loose(words, share, kind):
        for w in words:
            changed = rng.random() < share
            yield from {"replaced": noise(1), "gone": [], "added": [*noise(1), w]}[kind] if changed else [w]

    rows, item_of = [(-i, " ".join(noise(200))) for i in range(1, 40)], {}
    for item, text in items.items():
        for kind in ("replaced", "gone", "added"):
            for share in (0.1, 0.2, 0.3, 0.5):
                item_of[len(rows)] = item
                rows.append((len(rows), " ".join([*noise(rng.randint(0, 150)), *loose(text.split(), share, kind), *noise(rng.randint(0, 150))])))

    def held(text, item):
        words, whole, answer = decontamination.terms(text), decontamination.terms(items[item]), decontamination.answer_of(items[item])
        code = {w: k for k, w in enumerate({*words, *whole})}
        masks, part = (decontamination.masks_of([code[w] for w in x]) for x in (whole, answer))
        n, limits = len(whole), decontamination.LIMITS
        for lo in range(0, len(words), max(1, n // 8)):
            window = [code[w] for w in words[lo : lo + 2 * n]]
            share = decontamination.common_subsequence(masks, n, window) / n
            if share >= limits["verbatim"] or (
                share >= limits["paraphrase"] and decontamination.common_subsequence(part, len(answer), window) / len(answer) >= limits["answer"]
            ):
                return True
        return False

    want = {(i, item_of[i]) for i, text in rows if i in item_of and held(text, item_of[i])}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()}
    assert len(want) > 70
    assert len(got & want) >= 0.9 * len(want)
    assert all(item_of.get(i) == item for i, item in got)


def test_common_subsequence():
    random.seed(1)
    for _ in range(100):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.common_subsequence(decontamination.masks_of(a), len(a), b) == t[-1][-1]


def test_token_counts(spark, docs, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    spec = open(path, encoding="utf-8").read()
    library, t = Tokenizer.from_file(path), token_counts.Transducer(spec)
    random.seed(3)
    parts = ["a", "É", "ß", "Σ", "İ", "'s", "'", " ", "\n", "\x1c", "\x85", "　", "é", "1", "Ⅷ", "中", "!", "<|endoftext|>", "😀", "ﬁ", "가", "\x00"]
    for _ in range(500):
        s = "".join(random.choices(parts, k=random.randint(0, 40)))
        k = random.randint(1, 9)
        maps = [t.state_map(s[i : i + k].encode()) for i in range(0, len(s), k)] or [t.state_map(b"")]
        want = len(library.encode(s, add_special_tokens=False).ids)
        assert t.total(token_counts.scan(maps, t.compose)[-1]) == want
    out = token_counts.token_counts(docs, spec).collect()
    want = Counter((i, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in corpus())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert token_counts.token_counts(none, spec).count() == 0


def test_machine_equals_merging():
    """Words of common pairs, and tables that are forgotten on the way."""
    random.seed(6)
    letters = token_counts.byte_letters()
    text = lambda n: "".join(random.choices("abc", k=n))
    merges, parts = [], [x + e for x in "abc" for e in ("", token_counts.WORD_END)]
    while len(merges) < 60:
        a, b = random.choice(parts), random.choice(parts)
        if not a.endswith(token_counts.WORD_END) and (a, b) not in merges and a + b not in parts:
            merges.append((a, b))
            parts.append(a + b)
    machine, rank = token_counts.Machine(merges), {m: i for i, m in enumerate(merges)}
    for k in range(3000):
        if k % 1000 == 0:
            machine.clear()
        w = text(random.randint(1, 30))
        symbols = [letters[b] for b in w.encode()]
        symbols[-1] += token_counts.WORD_END
        assert machine.count(w.encode()) == len(token_counts.merged(symbols, rank))


def test_long_text_in_chunks(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    text = "The quick étude'll " * 9000
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    out = token_counts.token_counts(df, open(path, encoding="utf-8").read()).collect()
    assert [r["n_tokens"] for r in out] == [len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)] * 2


def test_toxicity(spark, docs, none):
    random.seed(6)
    plain = [" ".join(random.choices(["sun", "rain", "tree", "house", "walk", "talk"], k=random.randint(5, 150))) for _ in range(240)]
    texts = [t + " rotten vermin " + t if i % 3 == 0 else t for i, t in enumerate(plain)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(5000, 1), (None, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    out = {r["doc_id"]: r for r in toxicity.score(df, net).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] for i in held)
    assert sum(out[i]["predicted"] == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert out[1000]["score"] == out[1001]["score"] and all(0 <= r["score"] <= 1 for r in out.values())
    assert toxicity.keep_clean(df, net).count() == sum(r["predicted"] == 0 for r in out.values())
    assert toxicity.score(docs, net).count() == docs.count() and toxicity.score(none, net).count() == 0
    one = toxicity.fit(df, labels.where("toxic = 0"))
    assert toxicity.score(df, one).where("predicted = 1").count() == 0


def test_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.Net.fresh({f: i for i, f in enumerate({f for w in ("rotten", "tree") for f in toxicity.features(w)})}, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, y = [["rotten", "tree", "sun"], ["tree"]], np.array([1.0, 0.0])

    def loss():
        s = toxicity.Scorer(net).window_logits([" ".join(w) for w in windows])
        z = np.array([float(x[0]) for x in s], np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    grads = toxicity._step(net, windows, y)
    for name in ("w", "v", "A", "Uf", "Wb", "E"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        net.p[name][at] += 0.01
        up = loss()
        net.p[name][at] -= 0.02
        down = loss()
        net.p[name][at] += 0.01
        assert (up - down) / 0.02 == pytest.approx(float(grads[name][at]), rel=0.05, abs=1e-3)
