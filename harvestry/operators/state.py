"""Upserts, queues and deltas over tables keyed by item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero_filled_counts(rows: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """Rows per value of a closed domain, zeros included."""
    return domain.join(rows.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last writer of each key; one aggregation, no sort of whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def delta(remote: DataFrame, delivered: DataFrame, key: str, revision: str) -> DataFrame:
    """add, update, keep or delete for each key of either side."""
    r, d = remote.select(key, F.col(revision).alias("_r")), delivered.select(key, F.col(revision).alias("_d"))
    action = F.when(F.col("_d").isNull(), "add").when(F.col("_r").isNull(), "delete").when(F.col("_r") > F.col("_d"), "update").otherwise("keep")
    return r.join(d, key, "full").select(key, action.alias("action"))


def insert_missing(known: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """Known keys and those offered that aren't among them, the latter marked as new."""
    new = offered.select(key).distinct().join(known, key, "left_anti")
    return known.select(key, F.lit(False).alias("new")).unionByName(new.select(key, F.lit(True).alias("new")))


def save_items(rows: DataFrame, key: str) -> DataFrame:
    """The last revision of rows(key, revision, value, problems, text); a revision over an earlier one starts without problems. short_text is one line of 160 characters at most."""
    r = F.max_by(F.struct("value", "problems", "text"), "revision")
    flat = F.substring(F.trim(F.regexp_replace(F.col("r.text"), r"\s+", " ")), 1, 160)
    out = rows.groupBy(key).agg(F.max("revision").alias("revision"), r.alias("r"), F.count("*").alias("_n"))
    return out.select(key, "revision", F.col("r.value").alias("value"), F.when(F.col("_n") == 1, F.col("r.problems")).alias("problems"), flat.alias("short_text"))


def reconciled(processing, staged, inbox, moved):
    """What to do with an item after a crash: its row's status against what lies on disk."""
    return (
        F.when(processing & staged, "promote-staging").when(processing & inbox, "keep-inbox").when(processing, "mark-failed")
        .when(inbox, "keep-inbox").when(moved, "follow-move").when(staged, "restore-staging").otherwise("mark-missing")
    )


def deletions(remote: DataFrame, delivered: DataFrame, local: DataFrame, key: str, revision: str) -> DataFrame:
    """Per remote item: `delete` if it was delivered in this revision or a later one and is gone here, `restore` if it is newer, else null."""
    d = delivered.select(key, F.col(revision).alias("_d"))
    here = local.select(key, F.lit(True).alias("_l")).distinct()
    decision = F.when(F.col("_d").isNull() | F.col("_l").isNotNull(), None).when(F.col(revision) <= F.col("_d"), "delete").otherwise("restore")
    return remote.select(key, revision).join(d, key, "left").join(here, key, "left").select(key, decision.alias("decision"))


def stale(delivered: DataFrame, remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Local items that were delivered and are no longer remote. Nothing is stale where the remote side is empty: that is a failed listing, not a deletion."""
    some = remote.agg((F.count("*") > 0).alias("_some"))
    gone = delivered.join(remote, key, "left_anti").join(local, key, "left_semi").select(key)
    return gone.crossJoin(F.broadcast(some)).where("_some").drop("_some")  # one row on that side


def grouped_messages(rows: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Number the items of rows(keys, message_id, ts, album): albums stay whole, a gap of more than `seconds` after everything before starts an item."""
    unit = F.coalesce(F.concat(F.lit("a"), F.col("album").cast("string")), F.concat(F.lit("m"), F.col("message_id").cast("string")))
    named = rows.withColumn("_unit", unit)
    units = named.groupBy(*keys, "_unit").agg(F.min("ts").alias("_start"), F.max("ts").alias("_stop"), F.min_by("message_id", F.struct("ts", "message_id")).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_start", "_first")
    before = F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    gap = units.withColumn("_new", F.coalesce((micros(F.col("_start")) - micros(before) > seconds * 1e6).cast("long"), F.lit(1)))
    items = gap.withColumn("item", F.sum("_new").over(w)).select(*keys, "_unit", "item")
    return named.join(items, [*keys, "_unit"]).drop("_unit")


def only_value(rows: DataFrame, key: str, column: str, domain: list[str], out: str) -> DataFrame:
    """Per key the one value of a domain that occurs; null where none or several do."""
    v = F.when(F.col(column).isin(*domain), F.col(column))
    return rows.groupBy(key).agg(F.when(F.min(v) == F.max(v), F.max(v)).alias(out))


def zipped(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """Rows of both sides by position; keys whose sides differ in length have none."""
    size = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    same = size(left, "_a").join(size(right, "_b"), key).where("_a = _b").select(key)
    return left.join(right, [key, n]).join(same, key, "left_semi")


def through_cache(rows: DataFrame, cached: DataFrame, key: str, compute) -> DataFrame:
    """(key, source, value): from the cache, or computed where it has none."""
    hit = rows.join(cached.select(key, "value"), key).select(key, F.lit("cached").alias("source"), "value")
    miss = rows.join(cached, key, "left_anti").select(key, F.lit("computed").alias("source"), compute.alias("value"))
    return hit.unionByName(miss)


def numbered(rows: DataFrame, order: str, tie: str) -> DataFrame:
    """n counts all rows from 1 in order; new_day marks the first of each day. Days are counted and summed first, so that no task sorts more than a day."""
    day = F.to_date(order)
    sizes = rows.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    # one row for each day
    before = sizes.select(F.col("_day").alias("_of"), (F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy(order, tie))
    met = rows.withColumn("_day", day).withColumn("_k", inside).join(before, F.col("_day").eqNullSafe(F.col("_of"))).drop("_of")
    return met.withColumn("n", F.col("_before") + F.col("_k")).withColumn("new_day", F.col("_k") == 1).drop("_day", "_k", "_before")


def gap_sessions(rows: DataFrame, keys: list[str], ts: str, tie: str, seconds: float) -> DataFrame:
    """Number the sessions of each key: a new one starts where the gap to the row before is larger than `seconds`."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = (micros(ts) - F.lag(micros(ts)).over(w) > seconds * 1e6).cast("long")
    return rows.withColumn("session", F.sum(F.coalesce(fresh, F.lit(1))).over(w))


def first_wins(rows: DataFrame, key: str, order: str, out: str = "duplicate_of") -> DataFrame:
    """Point each row at the earliest row of its key; null for that one. The earliest are one aggregation, so a key with many rows is not one task."""
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    met = rows.join(first, rows[key].eqNullSafe(first._k))
    return met.withColumn(out, F.when(F.col(order) != F.col("_first"), F.col("_first"))).drop("_k", "_first")


def budgeted(rows: DataFrame, keys: list[str], order: list[str], many: int = 8, few_budget: int = 5, many_budget: int = 2) -> DataFrame:
    """The first rows of each key within its budget, which is smaller where there are many."""
    among = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= max(few_budget, many_budget))
    return ranked.join(among, keys).where(F.col("rank") <= F.when(F.col("_n") >= many, many_budget).otherwise(few_budget)).drop("_n")


def fair_share(rows: DataFrame, keys: list[str], need: str, rank: list, budget: int) -> DataFrame:
    """Water-filling: an equal share for each stream, then what is left over in rank order."""
    # all windows share one order over plain columns, so that a task sorts its rows once, and no key is carried twice
    ordered = Window.partitionBy(*keys).orderBy(*rank)
    w = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.greatest(F.floor(F.lit(budget) / F.count("*").over(w)), F.lit(1))
    base = rows.withColumn("share", F.least(F.col(need), share))
    spare = base.withColumn("spare", budget - F.sum("share").over(w)).withColumn("want", F.col(need) - F.col("share"))
    before = F.coalesce(F.sum("want").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spare.withColumn("granted", (F.col("share") + F.least("want", F.greatest(F.col("spare") - before, F.lit(0)))).cast("long")).drop("share", "spare", "want")
