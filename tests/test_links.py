"""Links by known answers: canonical forms, redirectors, identities, exclusion, priority, cleaning."""

import pytest
from pyspark.sql import functions as F

from harvestry.functions import cleaning
from harvestry.functions import text as tx
from harvestry.functions import urls as ur


def each(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CANONICAL = {
    "https://Example.com/a?utm_source=x&b=1": "https://example.com/a?b=1",
    "https://instagram.com/p/A/?igsh=MTk=": "https://instagram.com/p/A/",
    "https://x.com/a?is=1&rcm=2&CBRD=3&ref=4": "https://x.com/a?ref=4",
    "https://example.com/?q": "https://example.com/?q=",
    " http://example.com:80/a b?x=a%20b+c ": "http://example.com/a b?x=a+b+c",
    "https://example.com:8443/a?cp_landing_page=1#f": "https://example.com:8443/a#f",
    "https://u:p@example.com/?utm_source=x": "https://u:p@example.com/?utm_source=x",
    "ftp://example.com/?utm_source=x": "ftp://example.com/?utm_source=x",
}
HANDLERS = {
    "https://www.instagram.com/reel/Abc_-1/": "instagram", "https://instagram.com/someone": "document",
    "https://www.linkedin.com/posts/a_b-share-12-x": "linkedin", "https://www.linkedin.com/feed/update/urn:li:activity:12/": "linkedin",
    "https://youtu.be/abcdefghijk": "youtube", "https://www.youtube.com/watch?v=abcdefghijk&list=PL": "document", "https://m.youtube.com/shorts/abcdefghijk": "youtube",
    "https://arxiv.org/pdf/2401.01234v2.pdf": "research", "https://openreview.net/forum?id=x": "research", "https://jmlr.org/papers/volume3/a03a/a03a.pdf": "research",
    "https://openaccess.thecvf.com/content/CVPR2024/papers/A_b_CVPR_2024_paper.pdf": "research", "https://proceedings.neurips.cc/paper/2020/hash/ab-Abstract.html": "research",
    "https://www.researchgate.net/publication/12_Title": "research", "https://aclweb.org/anthology/P19-1001/": "research",
    "https://medium.com/@a/title-0123456789ab": "medium", "https://medium.com/p/0123456789ab": "document", "https://blog.example.com/title-0123456789ab": "medium", "http://medium.com/@a/title-0123456789ab": "document",
}
REASONS = [
    ("https://t.me/chan", "https://t.me/chan", "telegram-channel"), ("https://t.me/chan/5", "https://t.me/chan/5", None), ("https://t.me/+abc", "https://t.me/+abc", "telegram-channel"),
    ("https://t.me/s/chan", "https://t.me/s/chan", "telegram-channel"), ("https://t.me/s/chan/4", "https://t.me/s/chan/4", None), ("reddit.com", "https://reddit.com", "bare-hostname"), ("reddit.com/r/a", "https://reddit.com/r/a", None),
]
CLEANED = {
    "𝐁𝐨𝐥𝐝 𝘴𝘭𝘢𝘯𝘵 𝚖𝚘𝚗𝚘": "Bold slant mono", "She’s at 𝟭𝟮𝟯": "She's at 123", "7️⃣ steps, 🔟 goals": "7 steps, 10 goals", "Lunch 🍜🥢 soon": "Lunch soon", "A ⭐ for you ✅": "A ⭐ for you ✅", "Mind ⚠️ the gap ⚠": "Mind ⚠️ the gap ⚠",
    "#Monday #Coffee": "", "Our #Monday list": "Our Monday list", "hashtag#Coffee time": "Coffee time", "Item #4 of 9": "Item #4 of 9", "At https://a.example/b#part": "At https://a.example/b#part",
    "○ Round": "- Round", "    ▪ Square": "    * Square", "so — “fine” – it’s…": 'so - "fine" - it\'s...', "#+AUTHOR: Me  Too": "#+AUTHOR: Me  Too", "two  spaces , here ?": "two spaces, here?", "════": "════", "-----": "---", "— —": "- -",
    "See (https://a.example/x?utm_source=y&b=1).": "See (https://a.example/x?b=1).", "Мoney": "Money", "Привет": "Привет", "a\n\n\n\nb\n\n": "a\n\nb\n", "a\u200bb\u00ad": "ab", "": "",
    # by Unicode's emoji property: check marks and stars of text stay, signs with an emoji form go
    "✓ done ★": "✓ done ★", "© 2024 ®": "2024", "👩\u200d💻 🇩🇪 👍🏽 ok": "ok", "5 * 3 # 2": "5 * 3 # 2",
    # urls in code, in tags and in links
    "`https://a.example/?ref=1`": "`https://a.example/?ref=1`", '<a href="https://a.example/?ref=1">': '<a href="https://a.example/?ref=1">', "[https://a.example/?ref=1&c=2](https://a.example/?ref=1&c=2)": "[https://a.example/?c=2](https://a.example/?c=2)",
    "https://a.example/\u200bx?gclid=3 y": "https://a.example/x y",
}


def test_canonical(spark):
    assert each(spark, ur.canonical, CANONICAL) == list(CANONICAL.values())


def test_handlers(spark):
    assert dict(zip(HANDLERS, each(spark, ur.handler, HANDLERS))) == HANDLERS


def test_exclusion(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(REASONS)], "i int, raw string, u string, reason string")
    assert df.where(~ur.exclusion(F.col("raw"), F.col("u")).eqNullSafe(F.col("reason"))).count() == 0


def test_redirectors(spark):
    some = {
        "https://href.li/?https://a.example/x": "https://a.example/x", "https://www.google.com/url?url=https%253A%252F%252Fa.example": "https://a.example", "https://www.google.com/search?q=https://a.example": None,
        "https://eur02.safelinks.protection.outlook.com/?url=https%3A%2F%2Fa.example%2F&data=1": "https://a.example/", "https://l.facebook.com/l.php?u=https%3A%2F%2Fa.example&h=1": "https://a.example", "https://www.linkedin.com/safety/go?url=mailto%3Ax": None,
    }
    assert dict(zip(some, each(spark, ur.embedded, some))) == some
    assert each(spark, ur.shortened, ["https://www.bit.ly/x", "https://x.trib.al/y", "https://example.com"]) == [True, True, False]


def test_priority(spark):
    some = {"https://arxiv.org/abs/2401.01234": 1, "https://i.imgur.com/a.png": 9, "https://x.com/user": 9, "https://github.com/a/b": 3, "https://example.com/a": 4, "https://youtu.be/abcdefghijk": 5, "https://github.com/a": 4, "https://example.com/tags/x/y": 9}
    assert dict(zip(some, each(spark, lambda u: ur.priority(u, F.lit(False)), some))) == some
    assert each(spark, lambda u: ur.priority(u, F.lit(True)), ["https://github.com/a/b"]) == [2]


def test_trimmed(spark):
    some = {"https://a.example/x).": "https://a.example/x", "https://a.example/x_(y)": "https://a.example/x_(y)", "https://a.example/x_(y))!": "https://a.example/x_(y)", "https://a.example/{x}}": "https://a.example/{x}"}
    assert dict(zip(some, each(spark, ur.trimmed, some))) == some


@pytest.mark.parametrize("text", CLEANED)
def test_cleaned(text):
    assert cleaning.whole(text) == CLEANED[text]


def test_clean_text_column(spark):
    assert each(spark, cleaning.clean_text, ["x  y", None]) == ["x y", None]


def test_text_functions(spark):
    assert each(spark, lambda x: tx.truncate_words(x, 4), ["a b c", "a b\n\nc d\n\ne f", "a b c d e f", "a b c\n\nd e\n\nf"]) == ["a b c", "a b\n\nc d …", "a b c d …", "a b c …"]
    assert each(spark, lambda x: tx.cut_at_word(x, 10), ["short", "a longer line here", "abcdefghijkl"]) == ["short", "a longer…", "abcdefghi…"]
    assert each(spark, lambda x: tx.short_query(x, 3), ["a b. c d. e f.", "a b c d"]) == ["a b. c d.", "a b c d"]
    assert each(spark, tx.names_nothing, ["#a @b", "— !", "[x](https://a.example) ", "word #a"]) == [True, True, True, False]
    assert each(spark, tx.demote_heading, ["## a", "##### b", "c #"]) == ["#### a", "###### b", "c #"]
    assert each(spark, tx.kebab, ["ValueError", "HTTPError"]) == ["exception-value-error", "exception-httperror"]


def test_moments(spark):
    from harvestry.functions import media as me

    cases = {
        "2026-03-01T10:00:00Z": "2026-03-01T10:00:00Z", "2026-03-01 10:00:00+0230": "2026-03-01T07:30:00Z", "20260301T100000-05": "2026-03-01T15:00:00Z", "2026-03-01T10:00+01:00": "2026-03-01T09:00:00Z",
        "2026-03-01T00:30:15.25+01:00:15": "2026-02-28T23:30:00Z", "2026-03-01T10:00:00": None, "2026-03-01": None, "2026-13-01T10:00:00Z": None, "2026-03-01T10:00:00+25:00": None, "soon": None,
    }
    assert dict(zip(cases, each(spark, me.utc_moment, cases))) == cases
