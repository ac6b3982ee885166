"""The near-duplicate stage against comparing all documents, on near copies around similarity 0.8."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from harvestry.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_copies_like_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    common = [r.choice(words) for _ in range(30)]
    texts = [None, "", " \n", "one", "One", "one two three four", "one two three four five"]
    for _ in range(12):
        base = common + [r.choice(words) for _ in range(r.randint(5, 300))]
        for _ in range(r.choice([1, 8, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
                copy[r.randrange(len(copy))] = r.choice(words).upper()
            texts.append(" ".join(copy[r.randint(0, 3) :]))
    texts.append("word " * 20_000)
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    sets = [shingles(t) for t in texts]
    label, near, close = list(range(len(sets))), [[] for _ in sets], 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                near[i].append(j)
                close += a != b
    for _ in sets:
        label = [min(label[j] for j in near[i]) for i in range(len(sets))]
    assert close > 60 and any(label[i] != min(near[i]) for i in range(len(sets)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    for entries in (near_copies.GROUP_ENTRIES, 300):
        got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs, 5, group_entries=entries).collect()}
        assert got == dict(enumerate(label))
    assert {x.doc_id for x in corpus_pipeline.simhash_stage(spark, docs, "").collect()} == set(label)
    assert near_copies.near_copies(docs.limit(0), 5).count() == 0
    repeated = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "A  b"), (None, "c")], docs.schema)
    assert sorted(map(str, near_copies.near_copies(repeated, 5).collect())) == ["Row(doc_id=3, component_id=3)", "Row(doc_id=None, component_id=3)", "Row(doc_id=None, component_id=3)", "Row(doc_id=None, component_id=None)"]


def test_signatures_before_sets(spark, monkeypatch):
    """Pairs that merely share a shingle don't bring their sets into a shuffle; no pair at the threshold is lost."""
    r = random.Random(8)
    word = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    common = [word(14) for _ in range(6)]
    texts = [f"{word(r.choice([60, 90, 100, 150]))} {r.choice(common)}" for _ in range(60)]
    texts += [" ".join([*t.split()[1:], "x"]) for t in texts[:10]]
    written, write = {}, near_copies.materialise
    monkeypatch.setattr(near_copies, "materialise", lambda df, name, **o: (out := write(df, name, **o), written.setdefault(name, []).append(out.count()))[0])
    sets = near_copies._sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5)
    prefixes = near_copies._prefixes(sets, np.zeros(1 << near_copies.COUNT_BITS, np.uint8), 0.8)
    pairs = near_copies._rest(near_copies._index(prefixes.withColumn("label", F.col("set")), 1), 0.8)
    assert pairs.count() > 100
    assert near_copies._real(pairs, prefixes, sets, 0.8).count() == 10 <= written["pairs"][0] <= 15
