"""Items rendered from the messages that they were captured from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as ms


def read_payloads(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with their JSON payloads as a struct, `message`; a broken one is null."""
    return rows.withColumn("message", F.from_json(payload, ms.PAYLOAD))


def rendered_items(messages: DataFrame, item: str, transcripts: DataFrame | None = None) -> DataFrame:
    """(item, segments, body) of messages(item, message): every message as a Markdown segment, by date and message id.

    transcripts(item, message_id, position, text) come before a message's own content. Messages without an id take no
    part; a null date is 0. An item's messages are numbered by a window and joined in one row, as its body is one text.
    """
    p = F.col("message")
    rows = messages.where(p["message_id"].isNotNull()).select(item, p["message_id"].alias("message_id"), F.coalesce(p["date"], F.lit(0)).alias("date"), ms.content(p).alias("content"), ms.kind(p).alias("kind"))
    if transcripts is not None:
        said = transcripts.where(F.trim("text") != "").groupBy(item, "message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: F.trim(x["text"])), "\n\n").alias("said"))
        rows = rows.join(said, [item, "message_id"], "left")
    else:
        rows = rows.withColumn("said", F.lit(None).cast("string"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(item).orderBy("date", "message_id", "content")))
    heading = F.format_string("## Segment %d — %s", "n", "kind")
    section = F.array_join(F.array_remove(F.array(heading, F.coalesce("said", F.lit("")), "content"), ""), "\n\n")
    return numbered.groupBy(item).agg(F.count("*").alias("segments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", section.alias("section")))), lambda x: x["section"]), "\n\n").alias("body"))
