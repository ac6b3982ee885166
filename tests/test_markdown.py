"""The link scanner by known answers and against a second, plain one; documents rewritten from tables."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from harvestry.functions import scanner
from harvestry.operators import markdown as md

MIXED = (
    "Bare https://example.com).\n[https://same.test](https://same.test) [Existing title](https://titled.test) <https://auto.test>\n"
    '`https://code.test` ![image](https://image.test)\n[ref]: https://reference.test\n<a href="https://html.test">raw</a>\n```\nhttps://fenced.test\n```\n'
)
CASES = {
    "": [], "no link": [], "[a](b) [x]": [], "http://": [],
    "see https://a.test/x_(y), or (https://b.test).": [("bare", "https://a.test/x_(y)"), ("bare", "https://b.test")],
    "HTTPS://A.test!?": [("bare", "HTTPS://A.test")],
    "[t](https://a.test/(b)c 'x y')": [("titled", "https://a.test/(b)c")],
    "[t](<https://a.test> )": [("titled", "https://a.test")],
    "[t](https://a.test \"open": [("bare", "https://a.test")],
    "[broken\n](https://a.test)": [("bare", "https://a.test")],
    "[a [b](https://a.test)": [("titled", "https://a.test")],
    "~~~\nhttps://a.test\n```\nhttps://b.test": [],
    "````\n```\nhttps://a.test\n````\nhttps://b.test": [("bare", "https://b.test")],
    "    ```\nhttps://a.test": [("bare", "https://a.test")],
    "`` https://a.test ` `` https://b.test `x": [("bare", "https://b.test")],
    "`open https://a.test": [("bare", "https://a.test")],
    "<b title='https://a.test'>https://b.test</b>": [("bare", "https://b.test")],
    "a < b https://a.test > c": [("bare", "https://a.test")],
    " [x]: <https://a.test> t": [("autolink", "https://a.test"), ("reference", "https://a.test")],
    "[x]: not a url\n[y]:https://b.test.": [("reference", "https://b.test")],
    "ü [ñ](https://a.test/é) 🙂 https://b.test": [("titled", "https://a.test/é"), ("bare", "https://b.test")],
}


@pytest.mark.parametrize("text", CASES)
def test_kinds(text):
    assert [(x.kind, x.url) for x in scanner.links(text)] == CASES[text]


def test_mixed_document():
    assert [(x.kind, x.url, x.untitled) for x in scanner.links(MIXED)] == [
        ("bare", "https://example.com", True), ("markdown", "https://same.test", True), ("titled", "https://titled.test", False),
        ("autolink", "https://auto.test", True), ("image", "https://image.test", False), ("reference", "https://reference.test", False),
    ]


def test_positions_hold_what_they_name():
    rng = random.Random(3)
    pieces = ["[", "](", ")", "(", "`", "``", "```\n", "~~~", "\n", " ", "<", ">", "!", '"', "https://a.test/x", "http://b.test", "ü🙂", "]: ", "word", ".", "[t](https://c.test)", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 25)))
        found = scanner.links(text)
        for x in found:
            assert text[x.start : x.end] == x.url and x.span_start <= x.start and x.end <= x.span_end
            assert x.kind != "markdown" or text[x.label_start : x.label_end] == x.url
        spans = sorted((x.span_start, x.span_end) for x in found if x.kind != "reference")
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert scanner.redirected(text, lambda u: u) == text


def plain_scan(text):
    """Urls of a text without brackets, fences and definitions, by deleting code and tags."""
    text = re.sub(r"(`+)(?:(?!\1).)*\1", lambda m: " " * len(m[0]), text, flags=re.S)
    found = [(m.start(1), m[1]) for m in re.finditer(r"(?i)<(https?://[^<>\s]+)>", text)]
    text = re.sub(r"</?[A-Za-z][^>\n]*>", lambda m: " " * len(m[0]), text)
    return sorted(found + [(m.start(), scanner.trimmed(m[0])) for m in re.finditer(r"(?i)https?://[^\s<>\"\]]+", text) if not any(a == m.start() for a, _ in found)])


def test_planted_links_against_second_scanner():
    rng = random.Random(4)
    for _ in range(500):
        words = [rng.choice(["word", "a.b", "`https://c.test/1`", "https://d.test/2,", "(https://e.test/(3))", "<https://f.test/4>", '<i x="https://g.test/5">', "</i>", "1 < 2"]) for _ in range(rng.randrange(40))]
        text = " ".join(words)
        assert [(x.start, x.url) for x in scanner.links(text)] == plain_scan(text)


def test_linear_in_hostile_texts():
    for text in ("[" * 400_000, "`" * 3 + "` `` " * 100_000, "[a](" * 100_000, "<a" * 200_000, "](" * 200_000, "[](https://a.test 'x" * 20_000):
        began = time.time()
        scanner.links(text)
        assert time.time() - began < 20


def test_redirected_keeps_prose():
    assert scanner.redirected("Read https://bit.ly/item).", lambda u: "https://example.com/final") == "Read https://example.com/final)."
    assert scanner.redirected("[https://a.test](https://a.test) `https://a.test`", lambda u: "X") == "[X](X) `https://a.test`"


def test_rows_and_sql(spark):
    docs = spark.createDataFrame([(1, MIXED, 1), (2, None, 2), (3, "", 3), (4, "none", 4)], "doc_id long, text string, n int")
    rows = md.occurrences(docs, "doc_id", "text").orderBy("n").collect()
    assert [r["kind"] for r in rows] == ["bare", "markdown", "titled", "autolink", "image", "reference"] and {r["doc_id"] for r in rows} == {1}
    md.register(spark)
    docs.createOrReplaceTempView("notes")
    found = spark.sql("select doc_id, l.kind from notes, lateral link_occurrences(notes.text) l where l.untitled").collect()
    assert sorted(map(tuple, found)) == [(1, "autolink"), (1, "bare"), (1, "markdown")]


def test_entitle(spark):
    text = "https://short.test and https://short.test. [https://short.test](https://short.test) [Keep](https://short.test) <https://plain.test> https://unknown.test"
    docs = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "none", "k"), (None, "https://short.test", "k")], "doc_id long, text string, url string")
    to = spark.createDataFrame([("https://short.test", "https://final.test/a_(b)", "A [useful] _title_"), ("https://short.test", "https://z.test", "later"), ("https://plain.test", "https://p.test", None)], "url string, destination string, title string")
    got = {r["doc_id"]: r["text"] for r in md.entitle(docs, "doc_id", "text", to).collect()}
    named = r"[A \[useful\] \_title\_](https://final.test/a_\(b\))"
    assert got == {1: f"{named} and {named}. {named} [Keep](https://short.test) https://p.test https://unknown.test", 2: None, 3: "none", None: "https://short.test"}
    got = {r["doc_id"]: r["text"] for r in md.redirect(docs, "doc_id", "text", to).where(F.col("doc_id") == 1).collect()}
    f = "https://final.test/a_(b)"
    assert got == {1: f"{f} and {f}. [{f}]({f}) [Keep]({f}) <https://p.test> https://unknown.test"}
