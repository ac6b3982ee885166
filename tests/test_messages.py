"""Entities, hidden links, locations, kinds and rendered items by known answers, and slices against the standard library."""

import json
import random

from pyspark.sql import functions as F

from harvestry.functions import messages as ms
from harvestry.operators import messages as mo


def link(offset, length, url):
    return {"type": "text_link", "offset": offset, "length": length, "url": url}


CONTENTS = [
    ({"text": "Diffusion explainer\nGithub", "entities": [link(20, 6, "https://github.com/a"), link(0, 19, "https://a.github.io/d/")]}, "[Diffusion explainer](https://a.github.io/d/)\n[Github](https://github.com/a)"),
    ({"text": "🚀 Paper here", "entities": [link(9, 4, "https://arxiv.org/abs/2305.03509")]}, "🚀 Paper [here](https://arxiv.org/abs/2305.03509)"),
    ({"text": "click [me]", "entities": [link(0, 10, "https://example.com/a(b)c")]}, r"[click \[me\]](https://example.com/a\(b\)c)"),
    ({"text": "one two\nthree", "entities": [link(0, 3, "https://e.com/one"), link(1, 3, "https://e.com/over"), link(4, 9, "https://e.com/break"), link(4, 3, "ftp://e.com"), {"type": "url", "offset": 4, "length": 3}, {"type": "bold", "offset": 4, "length": 3}]}, "[one](https://e.com/one) two\nthree"),
    ({"caption": "Watch this", "caption_entities": [link(6, 4, "https://youtu.be/x")], "entities": [link(0, 5, "https://no.example")]}, "Watch [this](https://youtu.be/x)"),
    ({"text": "a  b", "entities": [link(1, 2, "https://blank.example"), link(True, 1, "https://e.com"), link(0, None, "https://e.com"), {"type": "text_link", "offset": 0, "length": 1}]}, "a  b"),
    ({"text": "🚀🚀", "entities": [link(0, 2, "HTTPS://e.com/1"), link(2, 2, "https://e.com/2"), link(1, 2, "https://e.com/torn")]}, "[🚀](HTTPS://e.com/1)[🚀](https://e.com/2)"),
    ({"location": {"latitude": 52.5, "longitude": -13}}, "### Location\nCoordinates: 52.5,-13\n[Open in maps](https://www.google.com/maps/search/?api=1&query=52.5,-13)"),
    ({"text": "At", "venue": {"title": "Café", "address": "1 Street", "location": {"latitude": 1.0, "longitude": 2e-7}}}, "At\n\n### Café\n1 Street\nCoordinates: 1.0,0.0000002\n[Open in maps](https://www.google.com/maps/search/?api=1&query=1.0,0.0000002)"),
    ({"venue": {"location": {"latitude": 1}}}, ""), ({}, ""), ({"text": ""}, ""), ({"text": "plain", "entities": "nothing"}, "plain"),
]
KINDS = [({"voice": {"d": 1}, "text": "x"}, "voice"), ({"text": ""}, "text"), ({"caption": "c", "photo": [1]}, "caption"), ({"venue": {"title": "t"}}, "venue"), ({"location": {}}, "location"), ({"photo": [1], "video": {"a": 1}}, "photo"), ({"photo": [], "video_note": {"a": 1}}, "video-note"), ({"forward_origin": {"t": 1}, "document": {"f": 2}}, "forwarded document"), ({}, "message")]


def read(spark, payloads):
    rows = [(i, json.dumps({"message_id": i, "date": 100, **p}, ensure_ascii=False)) for i, p in enumerate(payloads)]
    return mo.read_payloads(spark.createDataFrame(rows, "i int, payload string"))


def each(df, column):
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_contents(spark):
    assert each(read(spark, [p for p, _ in CONTENTS]), ms.content(F.col("message"))) == [x for _, x in CONTENTS]


def test_kinds_and_what_is_kept(spark):
    df = read(spark, [p for p, _ in KINDS])
    assert each(df, ms.kind(F.col("message"))) == [x for _, x in KINDS]
    assert each(df, ms.kept(F.col("message"))) == [True, True, True, False, False, True, True, True, False]


def test_slices_like_the_standard_library(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        text = "".join(rng.choices("aé🚀\n𝒳ж", k=rng.randrange(8)))
        rows.append((i, text, rng.randrange(-1, 9), rng.randrange(-1, 6)))

    def plain(text, offset, length):
        units = text.encode("utf-16-le")
        if offset < 0 or length <= 0 or 2 * (offset + length) > len(units):
            return None
        try:
            return units[2 * offset : 2 * (offset + length)].decode("utf-16-le")
        except UnicodeDecodeError:
            return None

    df = spark.createDataFrame(rows, "i int, t string, o int, n int")
    assert each(df, ms.entity_slice(F.col("t"), F.col("o"), F.col("n"))) == [plain(*r[1:]) for r in rows]


def test_rendered_items(spark):
    payloads = [{"message_id": 2, "date": 100, "text": "Статья", "entities": [link(0, 6, "https://arxiv.org/abs/1")]}, {"message_id": 1, "date": 100, "voice": {"x": 1}}, {"message_id": 3, "date": 50, "forward_from": {"id": 1}, "photo": [1]}]
    df = read(spark, payloads).withColumn("item", F.lit("a"))
    broken = spark.createDataFrame([(9, "{not json", "a"), (9, None, "b")], "i int, payload string, item string")
    said = spark.createDataFrame([("a", 1, 2, " second "), ("a", 1, 1, "first"), ("a", 1, 3, " "), ("z", 1, 1, "other")], "item string, message_id long, position int, text string")
    rows = mo.rendered_items(df.select("i", "payload", "item", "message").unionByName(mo.read_payloads(broken)), "item", said).collect()
    assert [tuple(r) for r in rows] == [("a", 3, "## Segment 1 — forwarded photo\n\n## Segment 2 — voice\n\nfirst\n\nsecond\n\n## Segment 3 — text\n\n[Статья](https://arxiv.org/abs/1)")]
    assert mo.rendered_items(df.limit(0), "item").collect() == []


def test_entity_links(spark):
    df = read(spark, [{"text": "see 🚀 e.com and more", "entities": [{"type": "url", "offset": 7, "length": 5}, link(13, 3, "https://h.example"), link(0, 99, "https://far.example"), {"type": "url", "offset": 5, "length": 2}]}])
    assert [[tuple(x) for x in row] for row in each(df, ms.entity_links(F.col("message")))] == [[("e.com", None, False), ("https://h.example", "and", True), ("https://far.example", None, True)]]
