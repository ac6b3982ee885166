"""Link tables: discovery order, one row for each target, exclusion and rank, harvest, and what a table says about its item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as ur

UNLISTED = ("duplicate", "excluded")


def distinct() -> Column:
    return ~F.col("status").isin(*UNLISTED)


def captured() -> Column:
    """Links the item arrived with."""
    return distinct() & (F.col("origin") != "harvest")


def extractable() -> Column:
    """Links worth a body."""
    return distinct() & (F.col("priority") != ur.PRIORITY["deprioritized"])


def link_table(found: DataFrame, item: str) -> DataFrame:
    """Per item one row for each target of found(item, stage, position, raw, label): the first occurrence, with the first label of all.

    Stages come one after the other (entities, then the body). Other schemes than http and https are no links. n numbers
    the targets; excluded ones stay in the table with their reason, but neither count nor rank.
    """
    url = ur.with_scheme(F.trim("raw"))
    # a column for each step: as one expression the parts of a url would be found again and again
    rows = found.where(ur.scheme(url).isin("http", "https")).withColumn("_url", ur.unwrapped(url)).withColumn("canonical", ur.canonical(F.col("_url")))
    order = F.struct("stage", "position")
    labelled = F.when(F.col("label").isNotNull(), order)
    one = rows.groupBy(item, "canonical").agg(F.min_by(F.struct("stage", "position", "raw"), order).alias("r"), F.min_by("label", labelled).alias("label")).select(item, "canonical", "r.*", "label")
    one = one.withColumn("reason", ur.exclusion(F.col("raw"), F.col("canonical"))).withColumn("status", F.when(F.col("reason").isNotNull(), "excluded").otherwise("discovered"))
    one = one.withColumn("handler", ur.handler(F.col("canonical")))
    w = Window.partitionBy(item)
    counted = one.withColumn("n", F.row_number().over(w.orderBy("stage", "position"))).withColumn("kept", F.count_if(F.col("status") != "excluded").over(w))
    rank = F.when(F.col("status") == "excluded", ur.PRIORITY["deprioritized"]).otherwise(ur.priority(F.col("canonical"), F.col("kept") == 1, F.col("handler")))
    return counted.withColumn("priority", rank).drop("kept", "stage", "position")


def primary(rows: DataFrame, item: str) -> DataFrame:
    """The best ranked link of each item."""
    return rows.where(distinct()).groupBy(item).agg(F.min_by("n", F.struct("priority", "n")).alias("n"))


def candidates(rows: DataFrame, item: str, threshold: int = 8, many: int = 2, few: int = 5) -> DataFrame:
    """The links whose bodies are worth their cost; items with many links have the smaller budget. Counts are one aggregation, ranks stop at the budget."""
    some = rows.where(extractable())
    size = some.groupBy(item).agg(F.count("*").alias("_k"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy("priority", "n"))).where(F.col("rank") <= max(many, few))
    return ranked.join(size, item).where(F.col("rank") <= F.when(F.col("_k") >= threshold, many).otherwise(few)).drop("_k")


def harvest(offered: DataFrame, known: DataFrame, item: str, limit: int) -> DataFrame:
    """The first `limit` new targets of offered(item, position, raw, canonical): not known, not excluded, worth extracting."""
    u = F.col("canonical")
    # grouped by a digest, so that the tests below run once for each target and not inside the steps that made it
    one = offered.join(known.select(item, "canonical").distinct(), [item, "canonical"], "left_anti").groupBy(item, F.sha2("canonical", 256)).agg(F.min_by(F.struct("position", "raw", "canonical"), "position").alias("r"))
    some = one.select(item, "r.*").where(ur.scheme(u).isin("http", "https") & ur.exclusion(F.col("raw"), u).isNull() & ~ur.deprioritized(u))
    return some.drop("raw").withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy("position"))).where(F.col("rank") <= limit)


def extraction_rollup(extractions: DataFrame, links: DataFrame, item: str) -> DataFrame:
    """(item, extraction, reason): extractions(item, priority, n, retrieved, complete, reason) rolled up in rank order; an item without any is partial if a link is unfinished."""
    order = F.struct("priority", "n")
    e = extractions.groupBy(item).agg(
        F.bool_or("retrieved").alias("some"), F.min_by(F.struct("reason"), order).alias("first"), F.min_by(F.struct("reason"), F.when(~F.col("complete"), order)).alias("bad")
    )
    u = links.groupBy(item).agg(F.min_by(F.struct("reason"), F.when(F.col("unfinished"), F.col("n"))).alias("open"))
    c = F.col
    status = F.when(c("some").isNull(), F.when(c("open").isNotNull(), "partial").otherwise("none")).when(~c("some"), "failed").when(c("bad").isNotNull(), "partial").otherwise("ok")
    reason = F.when(c("some").isNull(), c("open.reason")).when(~c("some"), c("first.reason")).otherwise(c("bad.reason"))
    return u.join(e, item, "left").select(item, status.alias("extraction"), reason.alias("reason"))
