"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ORDER with method-C escapes: in a context seen n times with d distinct
followers, a follower seen c times costs -log2(c / (n + d)) bits and an escape to the next shorter context
-log2(d / (n + d)); below order 0 each byte costs 8 bits. The statistics are frozen after training, so a byte's exact cost
in each language depends on the ORDER bytes before it alone. All contexts and followers that any language has seen become
one sorted table of costs; a text's code lengths are sums over its byte windows, found by binary search, and only
windows that no language has seen walk down the shorter contexts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

ORDER = 3
TRAIN_DOCS = 2000  # expected number of labelled documents of each language that the trees are fitted on
PAD = 0x0A  # what precedes every text


def _grams(raw: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """The n-byte window that ends at each byte, as an integer; texts start after n - 1 pads."""
    wide = raw.astype(np.uint32)
    key = wide.copy()
    starts = off[:-1]
    for k in range(1, n):
        key[k:] |= wide[:-k] << np.uint32(8 * k)
    for k in range(1, n):  # the k bytes before position p < k of a text are pads
        mask = np.uint32((0xFF << (8 * k)))
        for p in range(k):
            at = starts + p
            at = at[at < off[1:]]
            key[at] = key[at] & ~mask | np.uint32(PAD << (8 * k))
    return key


def _counts(batches):
    """(lang, window, n) of each partition, for windows of ORDER + 1 bytes."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(0).to_numpy(zero_copy_only=False)
        for lang in sorted(set(langs)):
            some = batch.filter(pa.array(langs == lang))
            for _, _, raw, off in text_chunks(some):
                keys, n = np.unique(_grams(raw, off, ORDER + 1), return_counts=True)
                if lang in total:
                    keys = np.concatenate([total[lang][0], keys])
                    n = np.concatenate([total[lang][1], n])
                    keys, at = np.unique(keys, return_inverse=True)
                    n = np.bincount(at, weights=n).astype(np.int64)
                total[lang] = keys, n
    for lang, (keys, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Trees:
    """Frozen context trees: per order, sorted windows with their costs in each language, and contexts with their escapes."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        shorter: tuple[np.ndarray, np.ndarray] | None = None  # windows and costs one order below
        self.levels = []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            seen = {}
            for lang in self.langs:
                grams, n = counts[lang]
                keys, at = np.unique(grams & mask, return_inverse=True)
                seen[lang] = keys, np.bincount(at, weights=n, minlength=len(keys))
            grams = np.unique(np.concatenate([k for k, _ in seen.values()]))
            contexts = np.unique(grams >> np.uint32(8))
            cost = np.zeros((len(grams), len(self.langs)), np.float32)
            escape = np.zeros((len(contexts), len(self.langs)), np.float32)
            lower = grams & np.uint32((1 << (8 * order)) - 1)
            below = np.full(len(grams), 8.0)[:, None] if shorter is None else shorter[1][np.searchsorted(shorter[0], lower)]
            at_context = np.searchsorted(contexts, grams >> np.uint32(8))
            for j, lang in enumerate(self.langs):
                keys, n = seen[lang]
                where = np.searchsorted(contexts, keys >> np.uint32(8))
                total = np.bincount(where, weights=n, minlength=len(contexts))
                distinct = np.bincount(where, minlength=len(contexts))
                known = total > 0
                escape[known, j] = -np.log2(distinct[known] / (total[known] + distinct[known]))
                cost[:, j] = escape[at_context, j] + below[:, min(j, below.shape[1] - 1)]
                place = np.searchsorted(grams, keys)
                cost[place, j] = -np.log2(n / (total[where] + distinct[where]))
            self.levels.append((grams, cost, contexts, escape))
            shorter = grams, cost

    @classmethod
    def frozen(cls, langs: list[str], levels: list) -> Trees:
        trees = cls.__new__(cls)
        trees.langs, trees.levels = langs, levels
        return trees

    def costs(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each window in each language."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        table, cost, contexts, escape = self.levels[order]
        at = np.minimum(np.searchsorted(table, grams), len(table) - 1)
        out = cost[at]
        miss = np.flatnonzero(table[at] != grams)
        if len(miss):
            rest = grams[miss]
            out[miss] = self.costs(rest & np.uint32((1 << (8 * order)) - 1), order - 1)
            context = rest >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            out[miss] += np.where((contexts[at] == context)[:, None], escape[at], 0)
        return out

    def bits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code lengths, a row for each text and a column for each language."""
        grams, step = _grams(raw, off, ORDER + 1), 1 << 18
        out = np.zeros((len(off) - 1, len(self.langs)))
        for lo in range(0, len(grams), step):
            part = grams[lo : lo + step]
            uniq, at = np.unique(part, return_inverse=True)
            each = self.costs(uniq)
            first, last = np.searchsorted(off, [lo, lo + len(part) - 1], side="right") - 1
            cuts = np.maximum(off[first : last + 1] - lo, 0)
            full = np.diff(np.append(cuts, len(part))) > 0
            for j in range(len(self.langs)):
                sums = np.add.reduceat(each[:, j][at], cuts[full], dtype=np.float64) if full.any() else np.zeros(0)
                out[first : last + 1][full, j] += sums
        return out


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Trees | None:
    """Trees of labelled(doc_id, text, lang): of each language about train_docs whole documents, chosen by a hash of doc_id."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row for each language
    if not sizes:
        return None
    slot = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    chosen = F.lit(False)
    for r in sizes:
        chosen = chosen | ((F.col("lang") == r.lang) & (slot < int((1 << 30) * min(1.0, train_docs / r.n))))
    counted = rows.where(chosen).select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # bounded by train_docs
    lang, gram, n = (table.column(k).to_numpy() for k in ("lang", "gram", "n"))
    counts = {}
    for x in sorted(set(lang)):
        mine = lang == x
        order = np.argsort(gram[mine])
        counts[x] = gram[mine][order].astype(np.uint32), n[mine][order]
    return Trees(counts) if counts else None


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, lang_pred, score.

    The language with the shortest code (ties: the first by name); score is its share when code lengths are turned into
    probabilities. A null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned.
    Only doc_id and text are read; repeated rows are kept.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees and (trees.langs, trees.levels))
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches):
        trees = Trees.frozen(*shared.value) if shared.value else None
        for batch in batches:
            n = batch.num_rows
            lang, best = np.full(n, "und", object), np.zeros(n)
            if trees is not None:
                for lo, rows, raw, off in text_chunks(batch, limit=4 << 20):
                    bits = trees.bits(raw, off)
                    at = bits.argmin(1)
                    lang[lo : lo + rows] = np.array(trees.langs, object)[at]
                    best[lo : lo + rows] = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                none = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                lang[none], best[none] = "und", 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select("doc_id", "text", letter).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
