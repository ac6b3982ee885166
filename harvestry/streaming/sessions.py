"""Streaming capture: messages grouped into sessions by event-time gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.StructType([T.StructField("route", T.StringType()), T.StructField("chat_id", T.LongType()), T.StructField("message_id", T.LongType()), T.StructField("received_at", T.TimestampType()), T.StructField("content", T.StringType())])


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MESSAGES).json(folder)


def sessions(messages: DataFrame, gap: str = "3 seconds", settle: str = "4 seconds") -> DataFrame:
    """Items of a route's chat; a session closes once the watermark has passed its end."""
    return (
        messages.withWatermark("received_at", settle)
        .groupBy("route", "chat_id", F.session_window("received_at", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("received_at", "message_id", "content"))).alias("messages"))
        .select("route", "chat_id", F.col("w.start").alias("started"), "n", F.array_join(F.transform("messages", lambda m: m["content"]), "\n\n").alias("body"))
    )


def current_messages(messages: DataFrame) -> DataFrame:
    """The last version of each message, for update mode: an edit, however late, is a new revision and never dropped."""
    return messages.groupBy("route", "chat_id", "message_id").agg(
        F.max_by("content", "received_at").alias("content"), F.min("received_at").alias("received_at"), F.max("received_at").alias("edited_at"), F.count("*").alias("revision")
    )


def processor_counters(runs: DataFrame) -> DataFrame:
    """Running counts of runs(processor, outcome), for update or complete mode."""
    return runs.groupBy("processor").agg(F.count("*").alias("runs"), *(F.count_if(F.col("outcome") == k).alias(k) for k in ("succeeded", "partial", "failed")))
