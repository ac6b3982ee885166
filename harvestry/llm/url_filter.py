"""URL filters as Bloom filter cascades.

Of each listed set (rules to allow, rules to block) level 1 encodes the listed keys, level 2 the corpus keys that pass
level 1 wrongly, level 3 the listed keys that pass level 2, and so on until nothing passes wrongly. Over the complete key
universe of the corpus, the host suffixes and path prefixes that any url can match, membership is then exact, and judging
a url takes no join: a few bit tests on filters whose size follows the list. Lists whose filters would exceed
`block_bytes` are split by key hash into blocks, and the pages pass through these one after the other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, mix64

BLOCK_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STATE = "array<tinyint>"


def host(url) -> F.Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url) -> F.Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url) -> F.Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


class Cascade:
    """Levels of (bits, hashes); keys come as pairs of 64-bit hashes."""

    def __init__(self, levels: list[tuple[np.ndarray, int]]):
        self.levels = levels

    @staticmethod
    def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int):
        a = mix64(h1 ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        b = h2 | np.uint64(1)
        for j in range(hashes):
            yield (a + np.uint64(j) * b) % np.uint64(bits)

    @staticmethod
    def passes(level: int, words: np.ndarray, hashes: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for p in Cascade.positions(h1, h2, level, len(words) * 64, hashes):
            ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe: a key is listed if the first level that it fails is an even one, or if it fails none of an odd number."""
        inside = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for k, (words, hashes) in enumerate(self.levels):
            ok = self.passes(k, words, hashes, h1[open_], h2[open_])
            inside[open_[~ok]] = k % 2 == 1
            open_ = open_[ok]
        return inside


def _encode(keys: DataFrame, level: int, n: int, rate: float) -> tuple[np.ndarray, int]:
    """A Bloom filter of n keys(h1, h2) at a false positive rate; its words are put together by Spark."""
    bits = max(64, -(-math.ceil(n * math.log2(1 / rate) / math.log(2)) // 64) * 64)
    hashes = max(1, round(math.log2(1 / rate)))

    def put(batches):
        for batch in batches:
            h1, h2 = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            p = np.unique(np.concatenate(list(Cascade.positions(h1, h2, level, bits, hashes)))) if len(h1) else np.zeros(0, np.uint64)
            at, first = np.unique(p >> np.uint64(6), return_index=True)
            words = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(words.view(np.int64))], ["at", "word"])

    rows = keys.mapInArrow(put, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # at most bits / 64 rows
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return words, hashes


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade for listed(h1, h2) that is exact over universe(h1, h2); both distinct."""
    spark = listed.sparkSession
    inside, outside = listed, universe.join(listed, ["h1", "h2"], "left_anti")
    n, s = inside.count(), outside.count()
    rate = min(0.5, math.sqrt(0.5) * max(n, 1) / max(s, 1))
    levels: list[tuple[np.ndarray, int]] = []
    written: list[DataFrame] = []
    while n:
        level = len(levels)
        levels.append(_encode(inside, level, n, rate))
        shared = spark.sparkContext.broadcast(levels[-1])

        def wrong(batches, level=level, shared=shared):
            for batch in batches:
                h1, h2 = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
                yield batch.filter(pa.array(Cascade.passes(level, *shared.value, h1, h2)))

        passed = materialise(outside.select("h1", "h2").mapInArrow(wrong, "h1 long, h2 long"), "cascade")
        written.append(passed)
        inside, outside = passed, inside
        n, rate = passed.count(), 0.5
    for table in written:
        drop_table(table)
    return Cascade(levels)


def _hashes(key) -> list[F.Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of pages(page_id, url): page_id, host, path, rule, verdict.

    rules(host, path, verdict) hold for their host and its subdomains where the url's path starts with theirs; the longest
    (host and path together, then host) wins, and an allowing rule over an equal blocking one. Without a rule, rule is null
    and the verdict is the default: the url's keys are on no list. A null url, or one without `://`, has an empty host and
    path. Rules with a null column are void, repeated rules count once, repeated pages are kept, other columns ignored.
    """
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), "verdict"
    )
    shapes = sorted(((r.labels, r.chars) for r in rules.select("labels", "chars").distinct().collect()), reverse=True)  # label counts by path lengths
    parts = pages.select("page_id", host("url").alias("host"), path("url").alias("path")).withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    labels = F.size(F.split("host", r"\."))
    fits = [F.when((labels >= n) & (F.length("path") >= c), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, c))) for n, c in shapes]
    keyed = parts.withColumn("keys", F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>"))
    hashed = keyed.withColumns({
        "h1": F.transform("keys", lambda k: F.xxhash64(k)), "h2": F.transform("keys", lambda k: F.xxhash64(k, F.lit("second"))),
        "state": F.lit(None).cast(_STATE),
    })
    universe = materialise(keyed.select(F.explode("keys").alias("key")).select(*_hashes("key")).distinct(), "universe")
    lists = rules.select(*_hashes("key"), "verdict").distinct()
    n = lists.count()
    blocks = max(1, -(-n * 64 // (8 * block_bytes)))  # 64 bits a key are ample
    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, host string, path string, keys array<string>, h1 array<bigint>, h2 array<bigint>, state {_STATE}"
    for b in range(blocks):
        mine = F.pmod("h1", F.lit(blocks)) == b
        filters = [(code, build(lists.where(mine & (F.col("verdict") == word)).select("h1", "h2"), universe.where(mine)).levels) for code, word in ((2, "block"), (1, "allow"))]
        shared = spark.sparkContext.broadcast(filters)

        def test(batches, b=b, shared=shared):
            for batch in batches:
                h1, h2 = (batch.column(k).flatten().to_numpy().view(np.uint64) for k in (4, 5))
                old = batch.column(6)
                state = np.zeros(len(h1), np.int8) if old.null_count else old.flatten().to_numpy().copy()
                here = np.flatnonzero(h1.view(np.int64) % blocks == b)
                for code, levels in shared.value:
                    state[here[Cascade(levels).member(h1[here], h2[here])]] = code
                sizes = np.cumsum([0, *batch.column(4).value_lengths().to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(state, pa.int8()))], batch.schema.names)

        hashed = hashed.mapInArrow(test, schema)
    drop_table(universe)
    found = F.filter(F.arrays_zip("keys", "state"), lambda x: x["state"] > 0)
    longest = F.reduce(found, F.lit(None).cast("struct<keys:string,state:tinyint>"), lambda a, x: F.when(a.isNull() | (F.length(x["keys"]) > F.length(a["keys"])), x).otherwise(a))
    return hashed.withColumn("best", longest).select(
        "page_id", "host", "path", F.col("best.keys").alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.state") == 2, "block").otherwise("allow").alias("verdict"),
    )
