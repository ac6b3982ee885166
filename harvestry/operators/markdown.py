"""Links of Markdown documents as rows, and documents rewritten from a table of resolved links.

`link_occurrences` is a table function for lateral joins, in SQL and in DataFrames. Rewriting is a join: each link asks
for its url's row in a table of resolutions, so a url is resolved once however often it occurs, and each document's
edits are then spliced into its text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scanner

SCHEMA = "n int, kind string, url string, url_start int, url_end int, span_start int, span_end int, label_start int, label_end int, label string, untitled boolean"


@F.udtf(returnType=SCHEMA, useArrow=True)
class LinkOccurrences:
    """A text's links in source order, n from 1; positions are code points from 0. A null text has none."""

    def eval(self, text: str):
        for n, x in enumerate(scanner.links(text or ""), 1):
            label = text[x.label_start : x.label_end] if x.label_start is not None else None
            yield n, x.kind, x.url, x.start, x.end, x.span_start, x.span_end, x.label_start, x.label_end, label, x.untitled


def register(spark: SparkSession) -> None:
    """Make link_occurrences(text) known to the session's SQL."""
    spark.udtf.register("link_occurrences", LinkOccurrences)


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, kind, url, ...) of all links in docs' texts; documents without links have no rows."""
    return docs.select(key, F.col(text).alias("_text")).lateralJoin(LinkOccurrences(F.col("_text").outer())).drop("_text")


@F.pandas_udf(StringType())
def spliced(texts: pd.Series, edits: pd.Series) -> pd.Series:
    """Texts with edits (start, end, new) made; without edits a text stays."""
    return pd.Series([t if t is None or e is None else scanner.spliced(t, [(x["start"], x["end"], x["new"]) for x in e]) for t, e in zip(texts, edits)])


def escaped_label(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\\[\]*_`])", r"\\$1")


def escaped_destination(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\()])", r"\\$1")


def _edited(docs: DataFrame, key: str, text: str, edits: DataFrame) -> DataFrame:
    """docs with `text` changed; edits(key, start, end, new)."""
    mine = edits.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("start", "end", "new")).alias("_edits"))
    return docs.join(mine, docs[key] == mine["_key"], "left").withColumn(text, spliced(F.col(text), F.col("_edits"))).drop("_key", "_edits")


def _resolved(docs: DataFrame, key: str, text: str, resolutions: DataFrame) -> DataFrame:
    found = occurrences(docs, key, text)
    known = resolutions.groupBy(F.col("url").alias("_url")).agg(F.min_by(F.struct("destination", "title"), F.struct("destination", "title")).alias("to"))
    return found.join(known, found["url"] == known["_url"], "left").drop("_url")


def redirect(docs: DataFrame, key: str, text: str, resolutions: DataFrame) -> DataFrame:
    """docs with the urls of their links replaced by resolutions(url, destination, title); unknown ones stay.

    A link labelled with its own url gets the new one as its label too. key names a document; null keys and null texts
    stay as they are. Of several resolutions of a url the smallest counts.
    """
    to = F.col("to.destination")
    rows = _resolved(docs, key, text, resolutions).where(to.isNotNull())
    places = [F.struct(F.col("url_start").alias("start"), F.col("url_end").alias("end"))]
    places.append(F.when(F.col("kind") == "markdown", F.struct(F.col("label_start").alias("start"), F.col("label_end").alias("end"))))
    edits = rows.select(key, to.alias("new"), F.explode(F.array_compact(F.array(*places))).alias("p")).select(key, "p.start", "p.end", "new")
    return _edited(docs, key, text, edits)


def entitle(docs: DataFrame, key: str, text: str, resolutions: DataFrame) -> DataFrame:
    """docs with bare, angled and self-labelled links replaced by titled ones, or by the plain destination where there is no title.

    Links that have a title, images and definitions stay, and so do links without a resolution.
    """
    to, title = F.col("to.destination"), F.col("to.title")
    rows = _resolved(docs, key, text, resolutions).where("untitled").where(to.isNotNull())
    titled = F.concat(F.lit("["), escaped_label(title), F.lit("]("), escaped_destination(to), F.lit(")"))
    edits = rows.select(key, F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.when(F.coalesce(title, F.lit("")) != "", titled).otherwise(to).alias("new"))
    return _edited(docs, key, text, edits)
