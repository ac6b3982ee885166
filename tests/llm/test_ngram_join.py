"""op13 against all pairs in plain Python."""

import random
import re
from itertools import combinations

import pytest

from harvestry.llm import ngram_join


def shingles(text, width=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), sorted."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, label int")
    return sorted(map(tuple, ngram_join.similar(df, **options).collect()), key=repr)


def edited(rng, words, edits):
    ws = list(words)
    for _ in range(edits):
        at = rng.randrange(len(ws))
        ws[at : at + 1] = rng.choice(([], [f"e{rng.randrange(10**6)}"], [ws[at], f"i{rng.randrange(10**6)}"]))
    return ws


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for group in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 5, 8, 30, 80, 200)))]
        for _ in range(rng.choice((1, 3, 20))):
            texts.append(" ".join(edited(rng, base, rng.choice((0, 0, 1, 1, 2, 3)))))
        # a passage that many share, with own words before it: close to the threshold on both sides
        texts.append(" ".join([f"u{group}x{i}" for i in range(rng.randrange(10))] + passage))
    texts += [texts[0].upper(), texts[1] + "\n", None, "", " \t\n", "one", "One", "one two three", "a b c d", "  İ b c d"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return [*rows, (3, texts[7]), (3, texts[3]), (None, texts[5]), (None, "nobody else has these words"), (None, None)]


@pytest.mark.parametrize("seed, block", [(1, ngram_join.BLOCK), (2, 40), (3, 1)])
def test_all_pairs(spark, seed, block):
    rows = corpus(seed)
    assert found(spark, rows, block=block) == brute(rows)


def test_dense_group(spark):
    """Near copies of one text: links on both sides of the threshold, far more pairs than rows."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.choice((1, 1, 2))))) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_chain(spark):
    """Each text links with the next alone."""
    rows = [(9 - i, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 60))) for i in range(10)]
    assert found(spark, rows) == brute(rows) and len({c for _, _, c in brute(rows)}) == 1


def test_threshold_is_inclusive(spark):
    """17 of 20 shingles are exactly 85 percent."""
    a = [f"w{i}" for i in range(23)]
    b = a[:20]
    assert found(spark, [(1, " ".join(a)), (2, " ".join(b))]) == [(1, 20, 1), (2, 17, 1)]
    assert found(spark, [(1, " ".join([*a, "more"])), (2, " ".join(b))]) == [(1, 21, 1), (2, 17, 2)]


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "x y z u v"), ("a", "X y z u v")], "doc_id string, text string")
    assert sorted(map(tuple, ngram_join.similar(df).collect())) == [("a", 2, "a"), ("b", 2, "a")]


def test_partial_overlaps_sum(spark):
    """A pair's segments meet in every fragment, and a difference in one of them decides."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows = [(i, " ".join(edited(rng, base, e))) for i, e in enumerate((0, 4, 6, 7, 8, 9, 12))]
    assert found(spark, rows) == brute(rows)
