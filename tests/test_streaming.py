"""The capture stream: sessions by gap, late edits as revisions, running counters."""

import json

from harvestry.streaming import sessions as ss


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def message(i, at, content, chat=1):
    return {"route": "inbox", "chat_id": chat, "message_id": i, "received_at": f"2026-01-01T00:00:{at:06.3f}Z", "content": content}


def drain(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_sessions_close_after_the_watermark(spark, tmp_path):
    put(tmp_path / "in", "a", [message(1, 0, "one"), message(2, 2.5, "two"), message(3, 6, "three"), message(9, 1, "other chat", 2)])
    put(tmp_path / "in", "b", [message(4, 59, "late enough to close the rest")])
    stream = ss.read_messages(spark, str(tmp_path / "in"))
    got = {(r.chat_id, r.body): r.n for r in drain(spark, ss.sessions(stream), "sessions", "append", tmp_path)}
    assert got == {(1, "one\n\ntwo"): 2, (1, "three"): 1, (2, "other chat"): 1}


def test_late_edits_are_revisions(spark, tmp_path):
    put(tmp_path / "in", "a", [message(1, 1, "first"), message(2, 30, "second")])
    put(tmp_path / "in", "b", [message(1, 5, "first, edited")])
    stream = ss.read_messages(spark, str(tmp_path / "in"))
    got = {r.message_id: (r.content, r.revision) for r in drain(spark, ss.current_messages(stream), "messages", "complete", tmp_path)}
    assert got == {1: ("first, edited", 2), 2: ("second", 1)}


def test_counters(spark):
    runs = spark.createDataFrame([("p", "succeeded"), ("p", "failed"), ("q", "partial")], "processor string, outcome string")
    assert {tuple(r) for r in ss.processor_counters(runs).collect()} == {("p", 2, 1, 0, 1), ("q", 1, 0, 1, 0)}
