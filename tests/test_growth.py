"""Steps whose rows must not grow with the square of a group, or whose queries come in parts."""

import random

from pyspark.sql import functions as F

from harvestry.functions import alike, cleaning
from harvestry.functions import text as tx
from harvestry.operators import frames, fuzzy, search


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK", 16)
    r = random.Random(3)
    base = ["".join(r.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(30)]
    texts = sorted({*base, *(x[:k] + "Z" + x[k + 1 :] for x in base for k in (5, 20)), *(x[4:] for x in base), *(x[9:] + "q" for x in base)})
    got = {(x.a, x.b) for x in fuzzy.alike_pairs(spark.createDataFrame([("g", t) for t in texts] + [(None, t) for t in texts], "k string, t string"), ["k"], "t").collect()}
    assert got == {(a, b) for a in texts for b in texts if a < b and alike.ratio(a, b) >= 88}


def test_parts_of_keys_meet_no_other_keys(spark):
    keys = ["ab", "abc", "xabcx", "b", "q", "abcdefghijklmn", "zabcdefghijklmnz", "abcdefghijklmo"]
    rows = spark.createDataFrame([("m", i, k) for i, k in enumerate(keys)], "media string, n int, text string")
    found = frames.worth_reading(rows, F.lit(True))
    assert sorted(x.text for x in found.collect()) == sorted(a for a in keys if not any(a != b and a in b for b in keys))


def test_queries_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 23}x" for k in range(6))) for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i}x w{i + 3}x w{i + 5}x") for i in range(12)], "item_id long, text string")
    best = lambda: sorted(map(tuple, search.bm25_best(docs, "doc_id", "text", asked, "item_id", "text", 2).collect()))
    whole = best()
    above = sorted(map(tuple, search.bm25(docs, "doc_id", "text", asked, "item_id", "text").where("score >= 2.5").select("item_id", "doc_id", "score").collect()))
    assert above and sorted(map(tuple, search.bm25_above(docs, "doc_id", "text", asked, "item_id", "text", 2.5).select("item_id", "doc_id", "score").collect())) == above
    monkeypatch.setattr(search, "TERMS", 20)
    monkeypatch.setattr(search, "bm25", None)
    assert best() == whole


def test_texts_are_cleaned_in_slices(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"Line {i}  of “text”\n\n\n• item") for i in range(150)], "doc_id long, text string").repartition(1)
    got = {x.doc_id: x.text for x in cleaning.cleaned(rows, "text").collect()}
    assert got == {x.doc_id: None if x.text is None else cleaning.whole(x.text) for x in rows.collect()}


def test_twins_without_arrays(spark):
    texts = ["aabb" * 10, "aaa" * 14, "abcd" * 10, "aAbB" * 10, "ab" * 15, None, ""]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.duplicate_layer(F.col("t")).alias("x"))
    assert "zip_with" not in out._jdf.queryExecution().analyzed().toString()
    assert [x.x for x in out.collect()] == [True, True, False, True, False, None, False]
