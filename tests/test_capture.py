"""Messages into items: the grouping rule, then a stream with edits, a quiet time and a restart."""

import json
import time

import pytest

from harvestry.streaming import capture as cp


def waiting(*rows):
    return [{"id": i, "at": at, "album": album} for i, at, album in rows]


GROUPS = [
    (waiting((1, 0, None), (2, 3, None), (3, 6, None), (4, 10, None)), [[1, 2, 3], [4]]),
    (waiting((1, 0, "a"), (2, 5, "a"), (3, 8, None)), [[1, 2, 3]]),
    (waiting((1, 0, "a"), (2, 1, None), (3, 20, "a"), (4, 22, None)), [[1, 2, 3, 4]]),
    (waiting((2, 0, None), (1, 0, None), (3, 3.001, None)), [[1, 2], [3]]),
    ([], []),
]


@pytest.mark.parametrize("messages, expected", GROUPS)
def test_groups(messages, expected):
    assert [[m["id"] for m in g] for g in cp.item_groups(messages, 3.0)] == expected


def test_settle_is_longer_than_the_gap(spark):
    with pytest.raises(ValueError):
        cp.capture(spark.createDataFrame([], cp.MESSAGES), gap=4.0, settle=4.0)


def test_stream(spark, tmp_path):
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def put(name, *rows):
        lines = [{"route": "inbox", "chat_id": chat, "message_id": i, "album": album, "received_at": f"2026-01-01T00:00:{at:02d}Z", "edited_at": edited and f"2026-01-01T{edited}Z", "content": text} for chat, i, at, album, edited, text in rows]
        (folder / f".{name}").write_text("\n".join(map(json.dumps, lines)))
        (folder / f".{name}").rename(folder / f"{name}.json")

    def start():
        df = spark.readStream.schema(cp.MESSAGES).json(str(folder))
        return cp.write_items(cp.capture(df, gap=3.0, settle=3.5), out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def rows(until, seconds=90):
        """The items once they are as many as expected, or what there is by then."""
        end = time.time() + seconds
        while True:
            try:
                got = {(r["chat_id"], r["item"]): (r["revision"], list(r["message_ids"]), r["body"]) for r in cp.current_items(spark, out).collect()}
            except Exception:  # nothing is written yet
                got = {}
            if until(got) or time.time() > end:
                return got
            time.sleep(1)

    query = start()
    try:
        put("a", (1, 1, 0, None, None, "one"), (1, 2, 3, None, None, "two"), (1, 3, 10, None, None, "three"), (2, 1, 0, "x", None, "left"), (2, 2, 9, "x", None, "right"))
        got = rows(lambda g: len(g) == 3)
        assert got == {(1, 1): (1, [1, 2], "one\n\ntwo"), (1, 2): (1, [3], "three"), (2, 1): (1, [1, 2], "left\n\nright")}
        # an edit of an item's message, the same once more, and a new message that waits
        put("b", (1, 2, 3, None, "09:00:00", "two, edited"), (1, 2, 3, None, "09:00:00", "two, edited"), (2, 3, 30, None, None, "waits"))
        assert rows(lambda g: g.get((1, 1), (0,))[0] == 2)[1, 1] == (2, [1, 2], "one\n\ntwo, edited")
    finally:
        query.stop()
    query = start()
    try:
        # goes on with what waits; an edit older than what is known changes nothing
        put("c", (1, 2, 3, None, "08:00:00", "two, older"))
        got = rows(lambda g: (2, 2) in g)
        assert got[2, 2] == (1, [3], "waits") and got[1, 1][0] == 2 and len(got) == 4
    finally:
        query.stop()
        spark.conf.set(kind, before)
