"""Frame merging: known answers, an independent pass over whole media, the fuzzy join against all pairs, the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from harvestry.functions import alike, tracks
from harvestry.operators import frames, fuzzy

BOX = (0.1, 0.2, 0.5, 0.1)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(80))) for _ in "ab")
        assert alike.common(a, b) == lcs(a, b)
        assert alike.ratio(a, b) == (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)
    words = [str(rng.randrange(50)) for _ in range(20_000)]
    assert alike.common(words, words) == 20_000 and alike.common(words, words[::2]) == 10_000


def test_keys():
    assert [alike.key(x) for x in ("ＡＢＣ", "Straße", "  H e-llo_1! ", "ﬁn", "…", "")] == ["abc", "strasse", "hello_1", "fin", "", ""]


def lines(spark, rows):
    """rows: (media, frame, time, text, box) with confidence 0.9."""
    return spark.createDataFrame([(m, f, i, t, x, 0.9, list(b)) for i, (m, f, t, x, b) in enumerate(rows)], frames.LINES)


def merged(spark, shown):
    rows = [("m", round(t * 10), float(t), x, BOX) for t, x in shown]
    return [(r["text"], r["seen"]) for r in frames.segments(lines(spark, rows)).orderBy("n").collect()]


CASES = [
    ([(0, "H"), (0.1, "HE"), (0.2, "HEL"), (0.3, "HELL"), (0.4, "HELLO")], [("HELLO", 5)]),
    ([(0, "Useful travel tip"), (1, "Useful travel tip"), (10, "Useful travel tip")], [("Useful travel tip", 3)]),
    ([(0.0, "Facundo Pinero"), (0.1, "Facundo Piñero"), (0.2, "Facundo Piñero"), (0.3, "Facundo Piero")], [("Facundo Piñero", 4)]),
    ([(0.0, "First useful idea"), (0.1, "Completely different advice")], [("First useful idea", 1), ("Completely different advice", 1)]),
    ([(0, "Useful travel tip"), (9, "Useful travei tip"), (20, "useful travel  tip!")], [("Useful travel tip", 3)]),
    ([(0, "a b"), (2.0, "A B"), (4.1, "ab")], [("a b", 3)]),
    ([(0, "…"), (0.1, " "), (0.2, "…")], [("...", 2)]),
]


@pytest.mark.parametrize("shown, expected", CASES)
def test_known_answers(spark, shown, expected):
    assert merged(spark, shown) == expected


def plain(rows):
    """Whole media at once, every comparison made anew: the segments of (media, frame, time, text, box)."""
    out = {}
    for media in sorted({r[0] for r in rows}):
        all_, active = [], []
        for _, frame, time, text, box in sorted((r for r in rows if r[0] == media), key=lambda r: r[1]):
            active = [t for t in active if time - t["last"] <= tracks.GAP]
            text = alike.one_line(text or "")
            if not text:
                continue
            fit = [t for t in active if tracks.related(t["box"], box) and any(alike.evolving_keys(k, alike.key(text)) for k, *_ in t["said"])]
            if fit:
                t = max(fit, key=lambda t: max(alike.ratio(k, alike.key(text)) for k, *_ in t["said"]))
            else:
                t = {"said": [], "first": time, "seen": 0}
                all_.append(t)
                active.append(t)
            t["said"].append((alike.key(text), text))
            t.update(last=time, box=box, seen=t["seen"] + 1)
        done = []
        for t in all_:
            spelt = {}
            for k, x in t["said"]:
                old = spelt.get(k, [x, 0])
                spelt[k] = [x if len(alike.key(x)) > len(alike.key(old[0])) else old[0], old[1] + 1]
            longest = max(spelt, key=len)
            if len({len(k) for k in spelt}) > 1 and all(longest.startswith(k) or longest.endswith(k) for k in spelt):
                text = spelt[longest][0]
            else:
                text = max(spelt.values(), key=lambda s: (s[1], len(alike.key(s[0]))))[0]
            own = alike.key(text)
            at = next((d for d in done if d["born"] == own), None) or next((d for d in done if tracks.related(d["box"], t["box"]) and min(len(alike.key(d["text"])), len(own)) >= 4 and alike.ratio(alike.key(d["text"]), own) >= 88), None)
            if at:
                at["text"] = text if len(own) > len(alike.key(at["text"])) else at["text"]
                at["box"] = t["box"] if t["last"] > at["last"] else at["box"]
                at.update(first=min(at["first"], t["first"]), last=max(at["last"], t["last"]), seen=at["seen"] + t["seen"])
            else:
                done.append({"born": own, "text": text, "box": t["box"], "first": t["first"], "last": t["last"], "seen": t["seen"]})
        out[media] = [(d["text"], d["first"], d["last"], d["seen"]) for d in done]
    return out


def test_against_plain_pass(spark):
    rng = random.Random(8)
    texts = ["Useful travel tip", "Useful travel tips", "Usefull trav tip", "Another line here", "Anothor line here", "Go", "GO!", "G", "...", "Straße", "STRASSE", "Follow for more", "Follow for morе", None, ""]
    rows = []
    for media in ("m1", "m2", "m3", "m4"):
        time = 0.0
        for frame in range(120):
            time += rng.choice([0.1, 0.1, 0.5, 2.5])
            text = rng.choice(texts)
            if text and rng.random() < 0.3:
                text = text[: rng.randrange(1, len(text) + 1)]
            rows.append((media, frame, time, text, rng.choice([BOX, (0.12, 0.21, 0.5, 0.1), (0.1, 0.7, 0.3, 0.1)])))
    expected = plain(rows)
    df = frames.segments(lines(spark, rows))
    got = {m: [] for m in expected}
    for r in df.orderBy("media", "n").collect():
        got[r["media"]].append((r["text"], r["first"], r["last"], r["seen"]))
    assert got == expected and sum(map(len, got.values())) > 40


def test_no_frames(spark):
    assert frames.segments(spark.createDataFrame([], frames.LINES)).collect() == []
    rows = spark.createDataFrame([("m", 1, 1, None, "image", None, [0.0, 0.0, 1.0, 1.0]), ("m", 1, 2, None, "lost", 0.5, None), ("m", 2, 1, None, "image", 0.7, [0.0, 0.0, 1.0, 1.0])], frames.LINES)
    assert [tuple(r) for r in frames.segments(rows).select("text", "confidence", "first", "seen").collect()] == [("image", 0.7, None, 2)]


def test_fuzzy_join_finds_all_pairs(spark):
    rng = random.Random(2)
    texts = set()
    for _ in range(60):
        base = "".join(rng.choices("abcdefgh", k=rng.choice((3, 4, 5, 6, 8, 12, 25, 60))))
        for _ in range(4):
            s = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
            texts.add("".join(s))
    texts = sorted(texts)
    df = spark.createDataFrame([(g, t) for t in texts for g in (1, 2)] + [(1, None), (3, texts[0])], "g int, t string")
    for least in (88.0, 85.0, 95.0):
        got = sorted((r["a"], r["b"]) for r in fuzzy.alike_pairs(df, ["g"], "t", least).where("g = 1").collect())
        assert got == [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if min(len(a), len(b)) >= 4 and 200 * lcs(a, b) / (len(a) + len(b)) >= least]


def test_alike_heads(spark):
    from harvestry import registry

    got = sorted(tuple(r) for r in registry.queries()["alike_heads"](spark, "/root/testdata/sf0.001").collect())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and source is not null").select("lang", "source", F.substring(F.regexp_replace("text", "[^A-Za-z]+", ""), 1, 60).alias("h")).collect()
    heads = {(r.lang, r.source, r.h) for r in rows if r.h and len(r.h) > 3}
    assert got == sorted((g, s, a, b, round(200 * lcs(a, b) / (len(a) + len(b)), 6)) for g, s, a in heads for x, y, b in heads if (x, y) == (g, s) and a < b and 200 * lcs(a, b) >= 88 * (len(a) + len(b)))


def test_stream(spark, tmp_path):
    from harvestry.streaming.frames import stream_tracks

    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = tmp_path / "in"
        folder.mkdir()

        def put(name, rows):
            (folder / f"{name}.json").write_text("\n".join(json.dumps({"media": m, "frame": f, "line": 0, "at": f"2026-01-01T00:00:{t:06.3f}Z", "text": x, "confidence": 0.9, "box": list(BOX)}) for m, f, t, x in rows))

        def run():
            df = spark.readStream.schema("media string, frame int, line int, at timestamp, text string, confidence double, box array<double>").option("maxFilesPerTrigger", 1).json(str(folder))
            q = stream_tracks(df).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            return sorted((r["media"], r["text"], r["seen"], round(r["last"] - r["first"], 3)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

        put("a", [("m", 0, 0.0, "H"), ("m", 1, 0.5, "HE"), ("k", 0, 0.2, "Another line")])
        put("b", [("m", 2, 1.0, "HELLO"), ("m", 3, 4.0, "Something else")])
        assert run() == [("k", "Another line", 1, 0.0), ("m", "HELLO", 3, 1.0)]
        # a new run goes on with the state of the last; the watermark ends what isn't seen again
        put("c", [("m", 4, 4.5, "Something else"), ("z", 0, 20.0, "last")])
        put("d", [("z", 1, 21.0, "last")])
        assert run() == [("k", "Another line", 1, 0.0), ("m", "HELLO", 3, 1.0), ("m", "Something else", 2, 0.5)]
    finally:
        spark.conf.set(kind, before)


def test_blocks_of_alike_strings(monkeypatch):
    """Most pairs of a block go by a few words of bits; hardly any string is compared sign by sign alone."""
    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(40, 61))) for _ in range(300)})
    texts = sorted({*texts, *(x[:20] + "zz" + x[24:] for x in texts[:30])})
    monkeypatch.setattr(fuzzy, "ratio", None)
    a, b, scores = fuzzy._meet(texts, texts, True, 88.0)
    expected = [(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and 200 * lcs(x, y) / (len(x) + len(y)) >= 88]
    assert sorted(zip(a.tolist(), b.tolist())) == expected and len(expected) >= 30
