"""Openings and headlines by known answers."""

from pyspark.sql import functions as F

from harvestry.functions import text as tx

OPENINGS = {
    "One two three four. More follows.": "One two three four.", "Short. Next one is longer here.": "Short. Next one is longer here.", "Title\nA paragraph with more words. And more.": "Title A paragraph with more words.",
    "Four words stand here\nnot this": "Four words stand here", "What you will need:\nflour and water": "What you will need: flour and water", "#tag #other\n\n  Then the text itself.": "Then the text itself.",
    "🚀\n— …\n@who #what\nOnly this": "Only this", "[a](https://a.example) [b](https://b.example)\r\nSaid about it all": "Said about it all", "https://a.example\nwww.b.example": "", "": "", " \n\t": "",
    "word " * 40: ("word " * 19).strip() + "…", "x" * 150: "x" * 99 + "…", "Wait … what is this? No.": "Wait … what is this?",
}
ITEMS = [
    # streams, abstract, excerpt, title, note, body, label, url
    (("Spoken words come first here.", "caption"), None, None, "Page", None, "", None, "https://e.com", "Spoken words come first here."),
    (("#only #tags", None), "An abstract says it best.", "Excerpt of the text.", "Page", None, "", None, "https://e.com", "An abstract says it best."),
    ((None, None), None, None, "A page with a title", "Visit this one day soon", "x", None, "https://e.com", "A page with a title"),
    ((None, None), None, None, None, "Visit this one day soon", "x", None, "https://e.com", "Visit this one day soon"),
    ((None, None), None, None, "Jane Doe", None, "[Jane](https://e.com)\nwrites about old maps", None, "https://e.com", "Jane Doe writes about old maps"),
    ((None, None), None, None, "1.2K views · 30 reactions | How to bake", None, "https://e.com", "label", "https://e.com", "How to bake"),
    ((None, None), None, None, None, None, "", "Label of it", "https://e.com", "Label of it"),
    ((None, None), None, None, "", None, "", None, "https://www.e.com/a/b/", "e.com/a/b"),
    ((None, None), None, None, None, None, None, None, None, "(untitled)"),
]


def test_openings(spark):
    df = spark.createDataFrame(list(enumerate(OPENINGS)), "i int, x string")
    assert [r["y"] for r in df.select("i", tx.first_sentence(F.col("x")).alias("y")).orderBy("i").collect()] == list(OPENINGS.values())


def test_headlines(spark):
    rows = [(i, *streams, *rest[:-1]) for i, (streams, *rest) in enumerate(ITEMS)]
    df = spark.createDataFrame(rows, "i int, s1 string, s2 string, abstract string, excerpt string, title string, note string, body string, label string, url string")
    c = F.col
    got = df.select("i", tx.headline([c("s1"), c("s2")], c("abstract"), c("excerpt"), c("title"), c("note"), c("body"), c("label"), c("url")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == [x[-1] for x in ITEMS]
