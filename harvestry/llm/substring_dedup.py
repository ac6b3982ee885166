"""Substring deduplication: windows of `depth` words that start earlier elsewhere.

Every word position starts a window. Windows are routed by a variable-length word prefix (one word, four words where one
is too common, the whole depth where even that is) into groups of bounded size. In a group they are sorted by their
digests: equal ones are what a suffix tree would hold under one node at that depth, and no tree is built, as that depth
alone decides. Of each such set the earliest window stays; the words of all others go, and consecutive ones join.

Only a window's 64-bit digest travels, never its text, so that windows count as equal by 64 bits; equal ones within a
chunk of text are merged first, so a passage that a third of all rows hold arrives once per chunk. Positions stay where
the text is: a group returns one bit per window, and the text meets these bits by chunk.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, powers, text_chunks, word_bounds, word_digests

DEPTH = 20
GROUP_LEAVES = 2_000_000  # leaves that a group aims at: 24 bytes each in its task
BUCKETS = 4096  # of the prefix histogram; fixed, so the driver's copy is bounded
_LAST = np.iinfo(np.int64).max  # the order of a null doc_id


_S = 0xD1342543DE82EF95
_SI = pow(_S, -1, 1 << 64)


def _leaf_digests(raw: np.ndarray, off: np.ndarray, depths: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(word index of each leaf, its digests at the given depths, words per text); leaves are word positions
    with at least depths[-1] words ahead in their text."""
    starts, ends, at = word_bounds(raw, off)
    n, counts = len(starts), np.diff(at)
    if not n:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in depths], counts
    word = word_digests(raw, starts, ends)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(word * powers(_S, n), out=run[1:])
    left = np.repeat(at[1:], counts) - np.arange(n)
    leaf = np.flatnonzero(left >= depths[-1])
    unit = powers(_SI, n)[leaf]
    return leaf, [mix64((run[leaf + d] - run[leaf]) * unit + np.uint64(d)) for d in depths], counts


def _chunks(batches):
    """(chunk id, doc_ids in order, their order keys, raw, off) with the rows of a batch ordered by doc_id; the same for the same input order."""
    seq = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(2)[0].as_py()
        batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_end"))
        ids = batch.column(0)
        key = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        for lo, n, raw, off in text_chunks(batch):
            yield task << 32 | seq, ids.slice(lo, n), key[lo : lo + n], raw, off
            seq += 1


class _Router:
    """Groups of leaves by variable-length prefixes: (shift-free) bucket of the first word -> depth, first group and number of groups."""

    def __init__(self, histogram: dict[int, int], leaves: int):
        count = np.zeros(BUCKETS, np.int64)
        for k, v in histogram.items():
            count[k] = v
        self.depth = np.where(count > 8 * leaves, 2, np.where(count > leaves // 2, 1, 0)).astype(np.int8)  # index into (1, 4, DEPTH)
        self.ways = np.maximum(1, -(-count // leaves) * np.where(self.depth > 0, 2, 1))
        light = np.flatnonzero(self.depth == 0)
        self.first = np.zeros(BUCKETS, np.int64)
        cum = np.cumsum(count[light]) // leaves
        self.first[light] = cum
        base = int(cum[-1]) + 1 if len(light) else 0
        for b in np.flatnonzero(self.depth > 0):
            self.first[b] = base
            base += int(self.ways[b])
        self.groups = base

    def __call__(self, digests: list[np.ndarray]) -> np.ndarray:
        b = (digests[0] % np.uint64(BUCKETS)).astype(np.int64)
        sub = np.where(self.depth[b] == 2, digests[2], digests[1])
        return self.first[b] + np.where(self.depth[b] > 0, (sub >> np.uint64(17)) % self.ways[b].astype(np.uint64), 0).astype(np.int64)


def _representatives(digest: np.ndarray) -> np.ndarray:
    """Mask of the first leaf of each digest; leaves are in (doc_id, start) order."""
    order = np.argsort(digest, kind="stable")
    ordered = digest[order]
    head = np.ones(len(order), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    mask = np.zeros(len(order), bool)
    mask[order[head]] = True
    return mask


def remove_repeats(docs: DataFrame, depth: int = DEPTH, group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words and keeps the empty string; a null doc_id sorts
    last. Rows that share a doc_id, repeated rows included, count in input order: the first keeps its words. Other
    columns are ignored. Two leaves are equal if the 64-bit digests of their words are. The input must yield its rows in
    the same order when read again, as a file scan does; a difference is detected and fails the job.
    """
    slim = docs.select("doc_id", "text", F.spark_partition_id().alias("task"))
    depths = (1, min(4, depth), depth)

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, raw, off in text_chunks(batch):
                _, digests, _ = _leaf_digests(raw, off, depths)
                total += np.bincount((digests[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    histogram = slim.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    route = _Router({r["bucket"]: r["n"] for r in histogram.collect()}, group_leaves)  # at most BUCKETS rows

    def leaves(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for chunk, _, key, raw, off in _chunks(batches):
            leaf, digests, counts = _leaf_digests(raw, off, depths)
            rep = _representatives(digests[-1])
            doc = np.repeat(key, counts)[leaf][rep]
            digests = [d[rep] for d in digests]
            group = route(digests)
            order = np.argsort(group, kind="stable")
            group, doc, digest = group[order], doc[order], digests[-1][order]
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(cuts[1:], len(group))
            if len(cuts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[cuts], pa.int64()), pa.array(np.full(len(cuts), chunk), pa.int64()),
                     pa.array([digest[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                     pa.array([pack.compress(doc[a:b].tobytes()) for a, b in zip(cuts, ends)], pa.binary())],
                    ["part", "chunk", "digests", "docs"],
                )

    def subtree(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        chunks = table.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable")
        blobs, docs_ = table.column("digests"), table.column("docs")
        digest = [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in order]
        doc = np.concatenate([np.frombuffer(unpack.decompress(docs_[int(i)].as_py()), np.int64) for i in order])
        sizes = np.array([len(d) for d in digest])
        digest = np.concatenate(digest)
        by_doc = np.argsort(doc, kind="stable")  # chunk order breaks ties
        late = np.ones(len(doc), bool)
        late[by_doc[_representatives(digest[by_doc])]] = False
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        bits = [pa.scalar(np.packbits(late[a:b]).tobytes(), pa.binary()) for a, b in zip(cuts[:-1], cuts[1:])]
        part = table.column("part")[0].as_py()
        return pa.table({"chunk": pa.array(chunks[order], pa.int64()), "part": pa.array([part] * len(bits), pa.int64()), "late": pa.array(bits, pa.binary()), "stamp": pa.array([int(np.bitwise_xor.reduce(digest[a:b])) & 0x7FFFFFFFFFFFFFFF for a, b in zip(cuts[:-1], cuts[1:])], pa.int64()), "texts": pa.nulls(len(bits), pa.binary())})

    def texts(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for chunk, ids, _, raw, off in _chunks(batches):
            sink = pa.BufferOutputStream()
            text = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes())])
            rows = pa.RecordBatch.from_arrays([pa.array(ids), text], ["doc_id", "text"])
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([pack.compress(sink.getvalue().to_pybytes())], pa.binary())],
                ["chunk", "part", "late", "stamp", "texts"],
            )

    def keep(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        is_text = table.column("texts").is_valid()
        flags = table.filter(pc.invert(is_text)).sort_by("part")
        rows = pa.ipc.open_stream(unpack.decompress(table.filter(is_text).column("texts")[0].as_py())).read_next_batch()
        _, _, raw, off = next(text_chunks(rows, limit=1 << 62))
        leaf, digests, counts = _leaf_digests(raw, off, depths)
        rep = _representatives(digests[-1])
        at = np.flatnonzero(rep)
        group = route([d[rep] for d in digests])
        order = np.argsort(group, kind="stable")
        group = group[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(cuts, len(group)))
        check = [int(np.bitwise_xor.reduce(x)) & 0x7FFFFFFFFFFFFFFF for x in np.split(digests[-1][rep][order], cuts[1:])] if len(cuts) else []
        if group[cuts].tolist() != flags.column("part").to_pylist() or check != flags.column("stamp").to_pylist():
            raise RuntimeError("the input came in another order when it was read again; write it to a table first")
        late = np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n).astype(bool) for b, n in zip(flags.column("late"), sizes)]) if len(cuts) else np.zeros(0, bool)
        gone = ~rep
        gone[at[order[late]]] = True
        n = int(counts.sum())
        cover = np.zeros(n + 1, np.int64)
        starts = leaf[gone]
        np.add.at(cover, starts, 1) if len(starts) else None
        np.subtract.at(cover, starts + depth, 1) if len(starts) else None
        kept = np.cumsum(cover[:-1]) == 0
        bounds = np.concatenate([[0], np.cumsum(counts)])
        removed = (counts - np.add.reduceat(np.append(kept, False), bounds[:-1]) * (counts > 0)).astype(np.int64)
        data, out = raw.tobytes(), []
        for i in range(len(counts)):
            words = data[off[i] : off[i + 1]].split()
            out.append(b" ".join(words if not removed[i] else compress(words, kept[bounds[i] : bounds[i + 1]])))
        return pa.table({
            "doc_id": rows.column(0), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()), "kept_text": pa.array([x.decode() for x in out], pa.string()),
        })

    shape = "chunk long, part long, late binary, stamp long, texts binary"
    flags = slim.mapInArrow(leaves, "part long, chunk long, digests binary, docs binary").groupBy("part").applyInArrow(subtree, shape)
    both = slim.mapInArrow(texts, shape).unionByName(flags)
    kind = dict(slim.dtypes)["doc_id"]
    return both.groupBy("chunk").applyInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
