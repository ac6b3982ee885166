"""The capture stream: messages of a chat become items once it has been quiet, and edits become revisions of theirs.

State is kept by route and chat: messages that wait, the item that each message went to, and each item's messages. A
chat's timer starts anew with each new message; when it runs out, what waits is cut into items by event time. Nothing is
dropped for being late: a message that is already in an item revises it. Needs a state store with timers and TTL
(RocksDB). What is written by batch can be written again, so a query that was killed goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP = 3.0  # seconds between two messages of an item
SETTLE = 4.0  # seconds of quiet after which a chat's messages become items
REMEMBER = 30 * 24 * 3600  # seconds for which an item takes edits after its last change
MESSAGES = "route string, chat_id long, message_id long, album string, received_at timestamp, edited_at timestamp, content string"
ITEMS = "route string, chat_id long, item long, revision int, message_ids array<long>, body string"


def item_groups(messages: list[dict], gap: float) -> list[list[dict]]:
    """Messages (id, at, album) cut where one starts more than gap after all before it; an album is one, from its first to its last."""
    units: dict[tuple, list[dict]] = {}
    for m in sorted(messages, key=lambda m: (m["at"], m["id"])):
        units.setdefault(("album", m["album"]) if m["album"] else ("message", m["id"]), []).append(m)
    groups: list[list[dict]] = []
    until = None
    for unit in sorted(units.values(), key=lambda u: (u[0]["at"], u[0]["id"])):
        if until is None or unit[0]["at"] - until > gap:
            groups.append([])
        groups[-1] += unit
        until = max(until or 0.0, unit[-1]["at"])
    return [sorted(g, key=lambda m: (m["at"], m["id"])) for g in groups]


class CaptureItems(StatefulProcessor):
    def __init__(self, gap: float, settle: float, remember: float):
        self.gap, self.settle, self.remember = gap, settle, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = int(1000 * self.remember)
        self.waiting = handle.getValueState("waiting", "messages string")
        self.count = handle.getValueState("count", "items long")
        self.item_of = handle.getMapState("item_of", "message long", "item long", ttl)
        self.items = handle.getMapState("items", "item long", "whole string", ttl)

    def _row(self, key, item: int, whole: dict) -> dict:
        messages = whole["messages"]
        return {"route": key[0], "chat_id": key[1], "item": item, "revision": whole["revision"], "message_ids": [m["id"] for m in messages], "body": "\n\n".join(m["content"] for m in messages if m["content"])}

    def _keep(self, item: int, whole: dict) -> None:
        self.items.updateValue((item,), (json.dumps(whole),))
        for m in whole["messages"]:
            self.item_of.updateValue((m["id"],), (item,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = {m["id"]: m for m in json.loads(self.waiting.get()[0])} if self.waiting.exists() else {}
        changed, new = {}, False
        seconds = lambda t: None if pd.isna(t) else t.timestamp()
        table = pd.concat(list(rows))
        found = [{"id": int(r.message_id), "at": seconds(r.received_at), "edited": seconds(r.edited_at) or seconds(r.received_at), "album": r.album or None, "content": r.content or ""} for r in table.itertuples()]
        for m in sorted(found, key=lambda m: (m["edited"], m["id"])):
            if self.item_of.containsKey((m["id"],)):
                item = self.item_of.getValue((m["id"],))[0]
                whole = changed.get(item) or json.loads(self.items.getValue((item,))[0])
                at = next(i for i, x in enumerate(whole["messages"]) if x["id"] == m["id"])
                old = whole["messages"][at]
                if m["edited"] > old["edited"] or m["edited"] == old["edited"] and m["content"] != old["content"]:
                    whole["messages"][at] = m | {"at": old["at"], "album": old["album"]}
                    whole["revision"] += item not in changed
                    changed[item] = whole
            else:
                before = waiting.get(m["id"])
                new = new or before is None
                waiting[m["id"]] = m if before is None else m | {"at": before["at"]}
        for item, whole in changed.items():
            self._keep(item, whole)
        if waiting:
            self.waiting.update((json.dumps(list(waiting.values())),))
        if new:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.settle))
        if changed:
            yield pd.DataFrame([self._row(key, item, whole) for item, whole in changed.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        count = self.count.get()[0] if self.count.exists() else 0
        out = []
        for group in item_groups(json.loads(self.waiting.get()[0]), self.gap):
            count += 1
            whole = {"revision": 1, "messages": group}
            self._keep(count, whole)
            out.append(self._row(key, count, whole))
        self.count.update((count,))
        self.waiting.clear()
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def capture(messages: DataFrame, gap: float = GAP, settle: float = SETTLE, remember: float = REMEMBER) -> DataFrame:
    """Items and their revisions (see ITEMS) of a stream of MESSAGES, in update mode.

    Messages without an id or a time take no part, a null album is none; the same version of a message twice changes
    nothing. Items are numbered by chat in the order in which they were made.
    """
    if settle <= gap:
        raise ValueError("a chat has to be quiet for longer than the gap within an item")
    usable = messages.where("message_id is not null and received_at is not null").select("route", "chat_id", "message_id", "album", "received_at", "edited_at", "content")
    return usable.groupBy("route", "chat_id").transformWithStateInPandas(CaptureItems(gap, settle, remember), ITEMS, "Update", "ProcessingTime")


def write_items(items: DataFrame, folder: str):
    """A writer of the stream into a folder by batch: a batch that runs again takes the place of its first try."""
    return items.writeStream.outputMode("update").foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}"))


def current_items(spark: SparkSession, folder: str) -> DataFrame:
    """The last revision of each item in the folder."""
    rows = spark.read.schema(ITEMS).parquet(folder)
    last = F.max_by(F.struct("revision", "message_ids", "body"), "revision").alias("r")
    return rows.groupBy("route", "chat_id", "item").agg(last).select("route", "chat_id", "item", "r.*")
