"""Redirect chains over tables of pages, addresses joined like the standard library does, the guard."""

import ipaddress
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from harvestry.functions import urls as ur
from harvestry.operators import redirects

H = "text/html"
PAGES = [
    # url, final_url, status, location, target, content_type, bytes, title
    ("https://bit.ly/item", None, 200, None, "https://short.test/next", H, 10, None), ("https://short.test/next", None, 200, None, "final", H, 10, None), ("https://short.test/final", None, 200, None, None, H, 10, "Final title"),
    ("https://short.test/item", None, 302, "https://final.test/article", None, None, None, None), ("https://final.test/article", None, 200, None, None, H, 10, "Final title"),
    ("https://bit.ly/a", None, 200, None, "https://short.test/b", H, 10, None), ("https://short.test/b", None, 200, None, "https://bit.ly/a", H, 10, None),
    ("https://bit.ly/dead", None, 200, None, None, H, 10, "Shortener"), ("https://e.test/none", None, 301, None, None, None, None, None), ("https://e.test/404", "https://e.test/gone", 404, None, None, H, 1, None),
    ("https://e.test/data", None, 200, None, None, "application/octet-stream", 4, None), ("https://e.test/big", None, 200, None, None, H, 5, "Big"), ("https://e.test/x.pdf", None, 200, None, None, "application/pdf", 6, "A paper"),
    ("https://e.test/untitled", None, 200, None, None, H, 1, None), ("https://e.test/self", None, 200, None, "https://e.test/self", H, 1, "Self"), ("https://e.test/lan", None, 302, "http://10.0.0.1/", None, None, None, None),
    *((f"https://long.test/{i}", None, 302, f"/{i + 1}", None, None, None, None) for i in range(12)),
]
OUTCOMES = {
    "https://bit.ly/item": ("https://short.test/final", "Final title", None, 2), "https://short.test/item": ("https://final.test/article", "Final title", None, 1),
    "https://bit.ly/a": ("https://bit.ly/a", None, "redirect-loop", 4), "https://bit.ly/dead": ("https://bit.ly/dead", None, "destination-not-found", 0),
    "https://e.test/none": ("https://e.test/none", None, "destination-not-found", 0), "https://e.test/404": ("https://e.test/gone", None, "http-error", 0), "https://e.test/data": ("https://e.test/data", None, "unsupported-content", 0),
    "https://e.test/big": ("https://e.test/big", None, "response-too-large", 0), "https://e.test/x.pdf": ("https://e.test/x.pdf", "A paper", None, 0), "https://e.test/untitled": ("https://e.test/untitled", None, "title-not-found", 0),
    "https://e.test/self": ("https://e.test/self", "Self", None, 0), "https://e.test/lan": ("http://10.0.0.1/", None, "unsafe-url", 1), "https://nowhere.test/": ("https://nowhere.test/", None, "request-error", 0),
    "https://long.test/0": ("https://long.test/10", None, "redirect-limit", 9), "https://long.test/3": ("https://long.test/12", None, "request-error", 9),
    "https://www.google.com/url?q=https%3A%2F%2Fe.test%2Fself": ("https://e.test/self", "Self", None, 1), "http://127.0.0.1/private": ("http://127.0.0.1/private", None, "unsafe-url", 0), "mailto:a@b.c": ("mailto:a@b.c", None, "unsafe-url", 0),
}


def test_chains(spark):
    links = spark.createDataFrame([(u, i) for i, u in enumerate([*OUTCOMES, *OUTCOMES, None])], "url string, n int")
    pages = spark.createDataFrame(PAGES, redirects.PAGES)
    got = {r["url"]: (r["final_url"], r["title"], r["reason"], r["hops"]) for r in redirects.resolve(links, pages, html_bytes=10, pdf_bytes=10).where("url <> 'https://e.test/big'").collect()}
    assert got == {u: x for u, x in OUTCOMES.items() if u != "https://e.test/big"}
    few = redirects.resolve(links, pages, html_bytes=4, pdf_bytes=10).where("url in ('https://e.test/big', 'https://e.test/x.pdf')").collect()
    assert {r["url"]: r["reason"] for r in few} == {"https://e.test/big": "response-too-large", "https://e.test/x.pdf": None}
    assert redirects.resolve(links.limit(0), pages).collect() == []


def test_second_attempt(spark):
    columns = "url string, final_url string, title string, reason string"
    first = spark.createDataFrame([("u1", "u1", None, "http-error"), ("u2", "u2", "Titled", None), ("u3", "u3", None, "title-not-found"), ("u4", "u4", None, "unsafe-url"), ("u5", "u5", None, "request-error"), ("u6", "u6", None, "http-error")], columns)
    second = spark.createDataFrame([("u1", "u1", "Accessible", None), ("u2", "u2", "Other", None), ("u3", "u3", None, "http-error"), ("u4", "u4", "No", None), ("u5", "https://e.test/x", None, "http-error")], columns)
    got = {r["url"]: (r["final_url"], r["title"], r["reason"]) for r in redirects.better(first, second).collect()}
    assert got == {"u1": ("u1", "Accessible", None), "u2": ("u2", "Titled", None), "u3": ("u3", None, "title-not-found"), "u4": ("u4", None, "unsafe-url"), "u5": ("https://e.test/x", None, "http-error"), "u6": ("u6", None, "http-error")}


BASES = ["https://a.test/b/c?q=1#f", "http://a.test", "https://a.test/b/", "https://[::1]:8080/x/y"]
REFERENCES = ["d", "/d", "//e.test/f", "?x=1", "#g", "../d", "./d/./e", "../../../d", "https://e.test", "d?e#f", "..", ".", "", "/a/../b/.", "mailto:a@b.c"]


@pytest.mark.parametrize("base", BASES)
def test_joined(spark, base):
    df = spark.createDataFrame([(base, r) for r in REFERENCES], "b string, r string")
    got = {r["r"]: r["x"] for r in df.select("r", ur.joined(F.col("b"), F.col("r")).alias("x")).collect()}
    expected = {r: urljoin(base, r) for r in REFERENCES}
    bare = lambda u: u.split("#")[0] if u.endswith("#") else u
    assert {r: bare(got[r]) for r in REFERENCES if r} == {r: bare(expected[r]) for r in REFERENCES if r}


def test_guard(spark):
    hosts = ["8.8.8.8", "10.1.2.3", "127.0.0.1", "169.254.169.254", "172.15.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "100.64.0.1", "100.128.0.1", "198.18.0.1", "198.20.0.1", "203.0.113.9", "0.1.2.3", "255.255.255.255", "192.0.0.9", "192.0.0.1", "1.1.1.1", "[::1]", "[fe80::1]", "[2606:4700::1111]", "[2001:db8::1]", "[fc00::1]"]
    df = spark.createDataFrame([(f"https://{h}/x",) for h in hosts], "u string")
    got = {r["u"][8:-2]: r["x"] for r in df.select("u", ur.unsafe(F.col("u")).isNull().alias("x")).collect()}
    assert got == {h: ipaddress.ip_address(h.strip("[]")).is_global for h in hosts}
    others = {"ftp://a.test": False, "https://": False, "https://u@a.test": False, "https://a.test:0/": False, "https://a.test:65535/": True, "https://a.test:70000/": False, "https://localhost/": False, "https://999.1.1.1/": True}
    df = spark.createDataFrame([(u,) for u in others], "u string")
    assert {r["u"]: r["x"] for r in df.select("u", ur.unsafe(F.col("u")).isNull().alias("x")).collect()} == others


def test_ipv6_hosts_stay_apart(spark):
    cases = {"https://[::1]:443/x?a=1": "https://[::1]/x?a=1", "http://[2001:DB8::2]:8080/": "http://[2001:db8::2]:8080/", "https://u:p@[::1]/": "https://u:p@[::1]/"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["x"] for r in df.select("u", ur.canonical(F.col("u")).alias("x")).collect()} == cases


def test_of_several_rows_the_smallest_counts_and_nulls_come_last(spark):
    pages = spark.createDataFrame([("https://e.test/a", None, 200, None, None, H, 1, None), ("https://e.test/a", None, 200, None, None, H, 1, "A title"), ("https://e.test/b", None, 301, None, None, H, 1, None), ("https://e.test/b", None, 301, "/a", None, H, 1, None)], redirects.PAGES)
    got = {r["url"]: (r["final_url"], r["title"], r["reason"], r["hops"]) for r in redirects.resolve(pages, pages).collect()}
    assert got == {"https://e.test/a": ("https://e.test/a", "A title", None, 0), "https://e.test/b": ("https://e.test/a", "A title", None, 1)}
