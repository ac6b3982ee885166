"""Folders of plans and notes, read as files and taken apart into retrieval units."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outline

# Plans and folders that hold machinery instead of notes.
SKIPPED_PLANS = ("workspace.org", "init.org")
SKIPPED_FOLDERS = (".git", ".obsidian", ".smart-env", ".trash", "image", "scripts", "Templates", "Bases")

UNITS = "kind string, line int, path string, title string, keyword string, text string"


@F.udtf(returnType=UNITS, useArrow=True)
class OutlineUnits:
    """Units of a plan's text; null has none."""

    def eval(self, text: str, file: str):
        yield from map(tuple, outline.outline_units(text or "", file or ""))


@F.udtf(returnType=UNITS, useArrow=True)
class NoteUnits:
    """Units of a note's text, windows of at most so many words; null has none."""

    def eval(self, text: str, file: str, window: int):
        yield from map(tuple, outline.note_units(text or "", file or "", window))


def plan_units(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, kind, line, path, title, keyword, text) of plans; rows that repeat a file are files of their own."""
    rows = files.select(F.col(file).alias("file"), F.col(text).alias("_text"))
    return rows.lateralJoin(OutlineUnits(F.col("_text").outer(), F.col("file").outer())).drop("_text")


def note_units(files: DataFrame, file: str = "file", text: str = "text", window: int = outline.WINDOW) -> DataFrame:
    rows = files.select(F.col(file).alias("file"), F.col(text).alias("_text"))
    return rows.lateralJoin(NoteUnits(F.col("_text").outer(), F.col("file").outer(), F.lit(window))).drop("_text")


def read_files(spark: SparkSession, root: str, suffix: str, skipped_files: Collection[str] = (), skipped_folders: Collection[str] = ()) -> DataFrame:
    """(file, text) of a folder's files at any depth, file below root; each file is one row, unreadable ones are left out."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": f"*{suffix}", "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    rows = spark.read.options(**options).text(root, wholetext=True).select(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")).alias("whole"), F.col("value").alias("text"))
    base = root.rstrip("/").partition("://")[2] or root.rstrip("/")
    rows = rows.withColumn("file", F.substring_index("whole", base + "/", -1))
    parts = F.split("file", "/", -1)
    keep = ~F.element_at(parts, -1).isin(*skipped_files) if skipped_files else F.lit(True)
    if skipped_folders:
        keep = keep & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, skipped_folders)))
    return rows.where(keep).select("file", "text")


def read_corpus(spark: SparkSession, plans: str, notes: str, window: int = outline.WINDOW) -> DataFrame:
    """The units of both folders, with their source, `org` or `vault`."""
    org = plan_units(read_files(spark, plans, ".org", SKIPPED_PLANS, (".git",))).withColumn("source", F.lit("org"))
    vault = note_units(read_files(spark, notes, ".md", (), SKIPPED_FOLDERS), window=window).withColumn("source", F.lit("vault"))
    return org.unionByName(vault)
