"""Benchmark decontamination: a prefix-filtered set join between item windows and document windows.

A window is `window` consecutive item words (an item with fewer words is one window). Document frequencies over all
documents order the words; of each window the rarest word is its necessary prefix token, as exact containment lets the
prefix filter keep one token. Documents meet the index by prefix tokens alone; the position of the token in its item
bounds where the window can lie, and the aligned run of equal words around it is the exact check, for all windows on
that diagonal at once.

The index travels as a broadcast of at most `block_bytes` of item text; a larger benchmark is split into such blocks and
the documents pass through them one after the other, without a shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BLOCK_BYTES = 32 << 20

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased: those letters fold, separators become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STATE = "n_words long, spans array<struct<begin:int,end:int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Lists of (item_id as string, words), each of about block_bytes of text."""
    named = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        part = named.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else named
        yield [(r.item_id, w) for r in part.toLocalIterator() if (w := words(r.text))]


def _index(items: list, frequency: dict[bytes, int], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """Prefix token -> [(item, position of the token in it)]."""
    at: dict[bytes, set[tuple[int, int]]] = {}
    for k, (_, w) in enumerate(items):
        rank = [(frequency.get(x, 0), x) for x in w]
        size = min(window, len(w))
        for s in range(len(w) - size + 1):
            p = min(range(s, s + size), key=lambda i: (*rank[i], i))
            at.setdefault(w[p], set()).add((k, p))
    return {w: sorted(v) for w, v in at.items()}


def _scan(doc: list[bytes], items: list, index: dict, window: int) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words inside occurring windows, and the items these are of."""
    spans, found, n = [], set(), len(doc)
    done: dict[tuple[int, int], int] = {}
    for i in [i for i, w in enumerate(doc) if w in index]:
        for k, p in index[doc[i]]:
            name, item = items[k]
            need = min(window, len(item))
            if min(i, p) + min(n - i, len(item) - p) < need or done.get((k, i - p), -1) > i:
                continue
            a, b = i, i + 1
            while a and a - i + p and doc[a - 1] == item[a - 1 - i + p]:
                a -= 1
            while b < n and b - i + p < len(item) and doc[b] == item[b - i + p]:
                b += 1
            done[k, i - p] = b
            if b - a >= need:
                spans.append((a, b))
                found.add(name)
    return spans, found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, spans of hit words (begin, end; disjoint, in order), items (sorted strings).

    A null or empty text has no words and no hits. Items with a null id or text, or without words, take no part; rows
    that repeat an item_id count as one item. Other columns are ignored, repeated documents are kept.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    state = docs.select("doc_id", "text", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<struct<begin:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for block in _blocks(benchmark, block_bytes):
        vocabulary = spark.sparkContext.broadcast(frozenset(w for _, ws in block for w in ws))

        def count(batches, vocabulary=vocabulary):
            total: Counter = Counter()
            for batch in batches:
                for text in batch.column(0):
                    total.update(vocabulary.value.intersection(words(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        # one row per word of the block at most
        frequency = {bytes(r.word): r.n for r in docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()} if vocabulary.value else {}
        shared = spark.sparkContext.broadcast((block, _index(block, frequency, window)))

        def scan(batches, shared=shared):
            items, index = shared.value
            for batch in batches:
                rows = []
                for text, spans, found in zip(batch.column(1), batch.column(3), batch.column(4)):
                    doc = words(text.as_py())
                    new, names = _scan(doc, items, index, window)
                    old = [(s["begin"], s["end"]) for s in spans.as_py() or ()]
                    rows.append((len(doc), [{"begin": a, "end": b} for a, b in _union(old + new)], sorted(names.union(found.as_py() or ()))))
                n, spans, names = zip(*rows) if rows else ((), (), ())
                span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

        state = state.mapInArrow(scan, f"doc_id {kind}, text string, {_STATE}")
    return state.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of contamination()'s rows."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["begin"])).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
