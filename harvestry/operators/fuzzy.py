"""Pairs of similar strings within groups, by insertions and deletions.

Two strings with a ratio of at least t differ by at most (1 - t) of their lengths' sum in insertions and deletions. Each
of these changes one count of signs, and at most three counts of pairs of signs: so counts that differ by more rule a
pair out before anything is compared. (No index does as much: at a ratio of 88, half of a string's pairs of signs may
change, and nearly all strings share one of the other half.) All pairs of a group so are looked at, a block of its
strings with a block at a time: counts of signs in unary, of which the bits that tell most are compared by exclusive or,
then whole counts, then all candidates' common subsequences a sign at a time; that is quadratic in a group, with a small
constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alike import ratio, similarity

FEW = 32  # strings of a group that are paired by a plain join
BLOCK = 2048  # strings of a block
SIGNS, PAIRS = 32, 64  # counts of signs and of pairs of signs, by their number modulo these
LEVELS, WORDS = 32, 2  # counts of a sign that are told apart in unary at most, and 64-bit words of the most telling bits
ROWS = 64  # strings of a block that are compared with another block at once
ALPHABET = 256  # signs of two blocks up to which candidates are compared together, and only those that fit into 63 bits


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, counts of signs, counts of pairs of signs) of texts."""
    size = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    kind = np.int16 if len(size) == 0 or size.max() < 1 << 14 else np.int64
    signs = np.bincount(row * SIGNS + code % SIGNS, minlength=len(texts) * SIGNS).reshape(-1, SIGNS).astype(kind)
    both = row[1:] == row[:-1]
    pair = (code[:-1] * 31 + code[1:])[both] % PAIRS
    return size, signs, np.bincount(row[:-1][both] * PAIRS + pair, minlength=len(texts) * PAIRS).reshape(-1, PAIRS).astype(kind)


def _unary(counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of counts of signs a row of WORDS numbers, which differ in at most as many bits as the counts do in all."""
    whole = np.concatenate(counts)
    share = np.stack([(whole > level).mean(axis=0) for level in range(LEVELS)])
    best = np.argsort(share * (1 - share), axis=None, kind="stable")[::-1][: 64 * WORDS]
    level, sign = best // whole.shape[1], best % whole.shape[1]
    return [np.ascontiguousarray(np.packbits(c[:, sign] > level, axis=1, bitorder="little")).view(np.uint64).T.copy() for c in counts]


def _ratios(left: list[str], right: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ratio() of left[a] and right[b], for all of them at once where signs and lengths allow."""
    sizes = [np.array([len(x) for x in texts], np.int64) for texts in (left, right)]
    flat = [np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) for texts in (left, right)]
    signs = np.unique(np.concatenate(flat))
    if len(signs) > ALPHABET or sizes[0].max(initial=0) > 63:
        return np.array([ratio(left[i], right[j]) for i, j in zip(a.tolist(), b.tolist())], float)
    row, at = (np.concatenate([np.arange(k) for k in sizes[0]] or [[]]).astype(np.uint64), np.repeat(np.arange(len(left)), sizes[0]))
    places = np.zeros((len(left), len(signs) + 1), np.uint64)
    np.bitwise_or.at(places, (at, np.searchsorted(signs, flat[0])), np.uint64(1) << row)
    code = np.full((len(right), int(sizes[1].max(initial=0))), len(signs), np.int64)
    code[np.arange(code.shape[1]) < sizes[1][:, None]] = np.searchsorted(signs, flat[1])
    code = np.ascontiguousarray(code.T)
    out = np.zeros(len(a))
    for lo in range(0, len(a), 1 << 15):
        x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
        full = (np.uint64(1) << sizes[0][x].astype(np.uint64)) - np.uint64(1)
        rest = full.copy()
        for k in range(int(sizes[1][y].max(initial=0))):
            hit = rest & places[x, code[k][y]]
            rest = ((rest + hit) | (rest - hit)) & full
        n = sizes[0][x] + sizes[1][y]
        out[lo : lo + len(x)] = 200.0 * (sizes[0][x] - np.bitwise_count(rest)) / np.maximum(n, 1)
    return out


def _meet(left: list[str], right: list[str], same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, ratio) of the pairs left[a], right[b], or of left alone, whose ratio is at least `least`."""
    n, signs, pairs = _counts(left)
    m, others, other_pairs = (n, signs, pairs) if same else _counts(right)
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not len(n) or not len(m):
        return found[0]
    own, against = _unary([signs, others])
    for lo in range(0, len(left), ROWS):
        begin = lo if same else 0
        most = np.floor((100 - least) / 100 * (n[lo : lo + ROWS] + m.max()) + 1e-9)
        bits = np.zeros((len(most), len(right) - begin), np.uint16)
        for w in range(WORDS):
            bits += np.bitwise_count(own[w, lo : lo + ROWS, None] ^ against[w, None, begin:])
        a, b = np.divmod(np.flatnonzero(bits <= np.minimum(most, 65535).astype(np.uint16)[:, None]), bits.shape[1])
        a, b = a + lo, b + begin
        if same:
            a, b = a[a < b], b[a < b]
        most = np.floor((100 - least) / 100 * (n[a] + m[b]) + 1e-9).astype(np.int64)
        for x, y, times in ((signs, others, 1), (pairs, other_pairs, 3)):
            near = np.abs(x[a] - y[b]).sum(axis=1) <= times * most
            a, b, most = a[near], b[near], most[near]
        found.append((a, b, np.zeros(len(a))))
    a, b, _ = (np.concatenate(x) for x in zip(*found))
    score = _ratios(left, right, a, b)
    near = score >= least
    return a[near], b[near], score[near]


def alike_pairs(strings: DataFrame, group: list[str], text: str, least: float = 88.0) -> DataFrame:
    """(*group, a, b, ratio), a < b: the distinct strings of a group whose ratio is at least `least`.

    Nulls and strings of fewer than four signs take no part; equal strings are one.
    """
    known = F.lit(True)
    for g in group:
        known = known & F.col(g).isNotNull()
    whole = strings.select(*group, F.col(text).alias("a")).where(known & (F.length("a") >= 4)).distinct()
    many = whole.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW)
    few = whole.join(many, group, "left_anti")
    n, m = F.length("a"), F.length("b")
    met = few.join(few.withColumnRenamed("a", "b"), group).where((F.col("a") < F.col("b")) & (200 * F.least(n, m) >= least * (n + m)))
    near = met.withColumn("ratio", similarity(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)
    blocks = F.ceil(F.col("_n") / BLOCK)
    block = F.pmod(F.xxhash64("a"), blocks)
    dealt = whole.join(many, group).select(*group, "a", block.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    dealt = dealt.select(*group, "a", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields if f.name != "a") + ", a string, b string, ratio double"

    def meet(table: pa.Table) -> pa.Table:
        own, texts = table.column("_own").to_numpy(), table.column("a").to_pylist()
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        left = [x for x, k in zip(texts, own) if k == i]
        right = left if i == j else [x for x, k in zip(texts, own) if k == j]
        a, b, scores = _meet(left, right, i == j, least)
        of = {g: pa.array([table.column(g)[0].as_py()] * len(a), table.column(g).type) for g in group}
        whole = sorted({*left, *right})
        place = {x: k for k, x in enumerate(whole)}
        x, y = (np.array([place[t] for t in side], np.int64)[k] for side, k in ((left, a), (right, b)))
        texts = pa.array(whole, pa.string())
        return pa.table(of | {"a": texts.take(pa.array(np.minimum(x, y))), "b": texts.take(pa.array(np.maximum(x, y))), "ratio": pa.array(scores, pa.float64())})

    return near.unionByName(dealt.groupBy(*group, "_i", "_j").applyInArrow(meet, schema))
