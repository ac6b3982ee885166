"""Recognised text of frames merged into segments with time ranges.

Lines run through a medium's tracks in order: a partition is sorted by medium and frame and read once, with only the
tracks in memory that are not over. Finished tracks are then collapsed by medium: which texts are alike comes from a
fuzzy join over the distinct keys, the merging itself goes through the tracks by their beginning.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alike, tracks
from .fuzzy import alike_pairs

#: media, frame and line order the lines; time is null for images
LINES = "media string, frame int, line int, time double, text string, confidence double, box array<double>"
PART = 12  # signs of a key's parts that are looked up whole
TRACK = "text string, confidence double, first double, last double, box array<double>, seen int, order array<int>"
_ARROW = pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("first", pa.float64()), ("last", pa.float64()), ("box", pa.list_(pa.float64())), ("seen", pa.int32()), ("order", pa.list_(pa.int32()))])


def _rows(media: str, found: list[dict]) -> pa.RecordBatch:
    rows = pa.array(found, _ARROW)
    return pa.RecordBatch.from_arrays([pa.array([media] * len(found), pa.string()), *rows.flatten()], ["media", *(f.name for f in _ARROW)])


def found_tracks(lines: DataFrame, gap: float = tracks.GAP) -> DataFrame:
    """(media, text, confidence, first, last, box, seen, order) of lines (see LINES): every run of a text that is seen again and again."""

    def run(batches):
        media, active = None, []
        rows = (row for batch in batches for row in batch.to_pylist())
        for (name, _), frame in groupby(rows, key=lambda r: (r["media"], r["frame"])):
            frame = list(frame)
            if name != media:
                if active:
                    yield _rows(media, [tracks.finished(t) for t in active])
                media, active = name, []
            active, over = tracks.advance(active, frame[0]["time"], [(r["text"], r["confidence"], tuple(r["box"]), [r["frame"], r["line"]]) for r in frame], gap)
            if over:
                yield _rows(media, [tracks.finished(t) for t in over])
        if active:
            yield _rows(media, [tracks.finished(t) for t in active])

    ordered = lines.where("box is not null and size(box) = 4").select("media", "frame", "line", "time", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "box")
    return ordered.repartition("media").sortWithinPartitions("media", "frame", "line").mapInArrow(run, f"media string, {TRACK}")


def segments(lines: DataFrame, gap: float = tracks.GAP) -> DataFrame:
    """(media, n, text, confidence, first, last, box, seen) of lines: what a medium's frames say, in the order of first sight.

    Equal texts of a medium are one segment, and so are nearly equal ones in the same place. Lines without a text or a
    box of four numbers take no part; a null confidence is 0.
    """
    found = found_tracks(lines, gap).withColumn("key", alike.text_key(F.col("text")))
    pairs = alike_pairs(found, ["media"], "key")
    both = pairs.select("media", F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("like")), F.struct(F.col("b").alias("key"), F.col("a").alias("like")))).alias("p")).select("media", "p.*")
    near = both.groupBy("media", "key").agg(F.collect_list("like").alias("alike"))
    whole = found.join(near, ["media", "key"], "left").drop("key")

    def merge(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        for media, mine in groupby(rows, key=lambda r: r["media"]):
            yield _rows(media, tracks.collapse((r, r["alike"] or []) for r in mine))

    merged = whole.repartition("media").sortWithinPartitions("media", "order").mapInArrow(merge, f"media string, {TRACK}")
    return merged.withColumn("n", F.row_number().over(Window.partitionBy("media").orderBy("order"))).drop("order")


def worth_reading(found: DataFrame, keep: Column) -> DataFrame:
    """The segments for a reader: those to keep, without those whose key is part of a longer one of the medium, each key once."""
    kept = found.where(keep).withColumn("key", alike.text_key(F.col("text"))).where("key <> ''")
    first = kept.groupBy("media", "key").agg(F.min_by(F.struct("n", "text"), "n").alias("r")).select("media", "key", "r.*")
    # short parts of a key are looked up as keys; a longer one is part of another only if its first PART signs are: those are joined
    size = F.length("key")
    cut = lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.col("key").substr(i, k))
    short = first.where(size >= 2).select("media", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(PART), size - 1)), cut)))).alias("key")).distinct()
    parts = first.where(size > PART).select("media", F.col("key").alias("whole"), F.explode(F.array_distinct(cut(F.lit(PART)))).alias("head"))
    long = first.where(size > PART).withColumn("head", F.substring("key", 1, PART)).join(parts, ["media", "head"])
    gone = short.unionByName(long.where((F.length("whole") > size) & F.contains("whole", F.col("key"))).select("media", "key"))
    return first.join(gone, ["media", "key"], "left_anti").select("media", "n", "text")
