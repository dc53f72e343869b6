"""The pipeline stage by stage against brute force, on documents with planted cases."""

import os
import random
from collections import Counter, defaultdict

import corpus_pipeline
from test_llm_operators import components, filled_targets, shingles, tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """Rows of documents, the ids of toxic ones, and the benchmark's items."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("bcdfglmnaeiou", k=6)) for _ in range(1500)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = {i: " ".join(prose(n)) for i, n in enumerate((15, 40, 90))}
    texts, toxic = [prose(rng.randint(20, 120)) for _ in range(260)], set(range(0, 260, 3))
    for i in toxic:
        texts[i][5:5] = ["rotten", "vermin"]
    for i in range(1, 200, 12):  # exact and near copies of clean documents, chains of them too
        texts.append(list(texts[i]))
        texts.append([*texts[i], *prose(1)])
        texts.append([*texts[-1], *prose(1)])
    for item in items.values():
        texts.append([*prose(30), *item.split(), *prose(40)])
    rows = [(i, " ".join(t), "en", ["a", "b", None, "é"][i % 4], 0) for i, t in enumerate(texts)]
    n = len(rows)
    return [*rows, (n, None, None, "a", None), (n + 1, "", "en", None, 0), (n + 2, "one two", "en", "b", 0)], toxic, items


def test_stages(spark, tmp_path, monkeypatch):
    rows, toxic, items = planted()
    tables = {
        "documents": (rows, COLUMNS),
        "labels": ([(r[0], None, int(r[0] in toxic)) for r in rows], "doc_id long, quality int, toxic int"),
        "benchmark": (list(items.items()), "item_id long, text string"),
    }
    for name, (content, schema) in tables.items():
        spark.createDataFrame(content, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    seen, expected = {}, spark.createDataFrame([], COLUMNS).schema.simpleString()

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = docs.collect()
            assert docs.schema.simpleString() == expected
            return stage(spark, docs, sf_dir)

        return name, run

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {name: [r["doc_id"] for r in found] for name, found in seen.items()}
    words = {r[0]: tokens(r[1]) for r in rows}

    clean = {r[0] for r in rows if r[0] not in toxic}
    kept = set(ids["near_duplicates"])
    assert clean <= kept and len(kept & toxic) <= 0.05 * len(toxic) and len(ids["near_duplicates"]) == len(kept)

    sets = {r[0]: shingles(r[1], 5) for r in rows if r[0] in kept}
    links = [(a, b) for a in kept for b in kept if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and sorted(ids["decontamination"]) == sorted(set(components(kept, links).values()))

    whole = [tuple(tokens(x)) for x in items.values()]
    holds = {i for i in words if any(tuple(words[i][k : k + len(x)]) == x for x in whole for k in range(len(words[i])))}
    assert len(holds & set(ids["decontamination"])) == len(items)
    assert sorted(ids["mixing"]) == sorted(set(ids["decontamination"]) - holds)

    source = {r[0]: r[3] for r in rows}
    sizes, longest, mixed = Counter(), Counter(), Counter()
    for i in ids["mixing"]:
        sizes[source[i]] += len(words[i])
        longest[source[i]] = max(longest[source[i]], len(words[i]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = filled_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    copies = Counter(ids["sharding"])
    assert set(copies) <= set(ids["mixing"]) and max(copies.values()) <= 2
    for i, n in copies.items():
        mixed[source[i]] += n * len(words[i])
    assert all(abs(mixed[s] - targets[s]) <= longest[s] for s in sizes)

    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
    assert Counter(r["doc_id"] for r in out) == copies and {r["law"] for r in out} == {"rows"}
    counts = [len(shards[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    left = [d for d in os.listdir(folder) if d.startswith("pipeline-")]
    assert [os.listdir(f"{folder}/{d}") for d in left] == [["3-mixing"]]
