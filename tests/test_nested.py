"""Redaction at any depth, JSON-LD titles by known answers, guarded and wrapped values."""

import json

from pyspark.sql import functions as F

from harvestry.functions import media as me
from harvestry.functions import nested


def test_redaction():
    value = {"url": "x", "a": [{"URL": 1, "b": {"cookie": [1], "c": None}}, [{"Http_Headers": {}}]], "k": "url", "": 0}
    assert nested.without_access(value) == {"url": "[redacted]", "a": [{"URL": "[redacted]", "b": {"cookie": "[redacted]", "c": None}}, [{"Http_Headers": "[redacted]"}]], "k": "url", "": 0}
    assert value["url"] == "x" and nested.without_access(3) == 3 and nested.without_access([]) == []
    deep = inner = {}
    for _ in range(100_000):
        inner["a"] = {}
        inner = inner["a"]
    inner["cookies"] = 1
    out = nested.without_access(deep)
    while "a" in out:
        out = out["a"]
    assert out == {"cookies": "[redacted]"}


def page(*blocks):
    return "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks)


TITLES = [
    (page({"@type": "Article", "headline": " A  &amp; B ", "name": "N"}), "A & B"), (page({"@type": ["Thing", "WebPage"], "name": "N"}), "N"), (page({"@type": "Person", "name": "N"}), None),
    (page("{broken", {"@graph": [{"@type": "newsArticle", "headline": "Deep"}]}), "Deep"), (page({"@type": "Article", "headline": "Not Found", "name": "Named"}), "Named"), (page({"@type": "Article", "headline": 3}), None),
    (page([{"@type": "Article", "headline": "first"}, {"@type": "Article", "headline": "last"}]), "last"), ("<SCRIPT data-x='1' TYPE=application/ld+json >[" + json.dumps({"@type": "Article", "headline": "T"}) + "]</SCRIPT>", "T"),
    ("<script>{}</script>", None), ("", None), (page({"x": [[1]] * 2000, "y": {"@type": "Article", "headline": "T"}}), "T"), (page({"y": {"@type": "Article", "headline": "T"}, "x": [[1]] * 2000}), None),
]


def test_titles(spark):
    assert [nested.linked_data_title(p) for p, _ in TITLES] == [t for _, t in TITLES]
    html = page({"@type": "Article", "headline": "Linked"}) + "<title>Document title</title><h1>Heading</h1>"
    shared = '<meta name="twitter:title" content="Shared">' + html
    df = spark.createDataFrame([(0, html), (1, shared), (2, None), (3, "<title>T</title>")], "i int, x string")
    got = df.select("i", me.html_title(F.col("x"), F.lit("e.com"), nested.json_ld_title(F.col("x"))).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == ["Linked", "Shared", None, "T"]


def test_values(spark):
    rows = ['])}while(1);</x>{"title": {"value": "T"}, "n": 3, "authors": {"value": ["A", "B"]}}', '{"title": "plain", "n": {"value": 4}, "authors": ["C"]}', '{"title": {"other": 1}, "authors": null}', "not json", "{broken", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    v = nested.parsed(F.col("x"))
    got = df.select("i", *(nested.unwrapped(v, n).alias(n) for n in ("title", "n", "authors"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("T", "3", "A, B"), ("plain", "4", "C"), (None, None, None), (None, None, None), (None, None, None), (None, None, None)]
    assert [r[0] for r in df.select(nested.redacted(F.regexp_replace("x", r"(?s)^[^{]*", ""))).collect()][3:] == [None, None, None]
