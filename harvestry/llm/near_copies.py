"""Near copies by an exact similarity join over sets of word shingles, and their components.

A document is the set of its shingles of `width` lower-cased words, each known by a digest. Ordered by rarity (counts over
all documents in a fixed number of hash buckets), sets with a Jaccard similarity of at least t share one of their first
n - ceil(t n) + 1 shingles: these are the index, whose groups discard pairs that length and positions rule out. Of the
remaining pairs, parity signatures (each shingle flips one bit, so two sets differ in at least as many shingles as in
bits) discard those too far apart; all shingles of the others decide, so that neither a link nor a pair without one hangs
on chance.

Equal sets count as one. A first round checks the pairs that SimHash brings (fingerprints of the shingles, within three
bits, by the cells of simhash.py) and for each set the partners it shares most with among the hubs of its shingles. Near
copies at similarity 0.8 differ in up to 14 of 64 bits and more, which no grid cell survives: so the second round checks
all pairs that these links left in different components. A large cluster of near copies gives rows in proportion to its
size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, mix64, shuffled, small_batches, text_chunks, word_bounds, word_digests
from .simhash import components as connected
from .simhash import hub_links

THRESHOLD = 0.8
COUNT_BITS = 20  # buckets of the counts of shingles, as a power of two
GROUP_ENTRIES = 300_000  # that a group of the index aims at
CHUNK = 1 << 18  # bytes of text, so that a chunk's arrays stay in the processor's cache
PAIRS = 1 << 20  # that a group looks at together
SLICE_BITS = 12  # buckets of a slice of the counts, as a power of two
WANTED_BITS = 24  # places of the bitmap of sets to verify: at most 2 ** (WANTED_BITS - 6) rows of 16 bytes are broadcast
HUBS = 3  # partners of a set in the first round
SIGN_BITS = 64, 8192  # of a signature, least and most: a power of two, at least one for each shingle in between
_HASH = 56  # bits of a key below its rarity
_KEPT = 5  # bytes of a key that a prefix keeps; sets that meet by chance only add pairs to check
_ENTRY = [("key", np.uint32), ("set", np.int64), ("label", np.int64), ("n", np.int32), ("at", np.int32)]


def _slices(count: np.ndarray) -> pa.RecordBatch:
    """(slice, counts) of a histogram, without its empty slices."""
    pack = zstandard.ZstdCompressor(level=1)
    parts = count.reshape(-1, 1 << SLICE_BITS)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack.compress(parts[i].tobytes()) for i in some], pa.binary())], ["slice", "counts"])


def _total(slices: DataFrame, bits: int) -> np.ndarray:
    """The sum of histograms: (slice, counts, salt); at most 2 ** bits numbers reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(unpack.decompress(x.as_py()), np.int64)
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([pack.compress(total.tobytes())], pa.binary())})

    few = slices.groupBy("slice", "salt").applyInArrow(add, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    total = np.zeros((1 << bits - SLICE_BITS, 1 << SLICE_BITS), np.int64)
    with small_batches(slices.sparkSession):
        rows = few.collect()
    for r in rows:
        total[r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), np.int64)
    return total.ravel()


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] of them) for all i."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, set, n, keys): the digests of a document's n shingles, 8 bytes each, ascending, and a name for their set; fewer words are one shingle."""
    kind = dict(docs.dtypes)["doc_id"]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def read(batches):
        for batch in batches:
            for lo, rows, raw, off in text_chunks(batch, limit=CHUNK):
                raw = lower[raw]
                starts, ends, at = word_bounds(raw, off)
                digest = word_digests(raw, starts, ends)
                words = np.diff(at)
                size = np.where(words >= width, words - width + 1, np.minimum(words, 1))
                doc = np.repeat(np.arange(rows), size)
                begin, span = _ranges(at[:-1], size), np.minimum(words, width)[doc]
                key = span.astype(np.uint64)
                for k in range(width):
                    word = digest[np.minimum(begin + k, len(digest) - 1)]
                    key = np.where(k < span, mix64(key * np.uint64(0xD1342543DE82EF95) + word), key)
                by = np.lexsort((key, doc))
                key, doc = key[by], doc[by]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[new], doc[new]
                n = np.bincount(doc, minlength=rows)
                name = np.zeros(rows, np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    name[some] = mix64(np.add.reduceat(mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), np.cumsum(n[some]) - n[some]) + n[some].astype(np.uint64))
                off = pa.array(8 * np.concatenate([[0], np.cumsum(n)]), pa.int32())
                packed = pa.Array.from_buffers(pa.binary(), rows, [None, off.buffers()[1], pa.py_buffer(key.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(name.view(np.int64)), pa.array(n, pa.int32()), packed], ["doc_id", "set", "n", "keys"])

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, set long, n int, keys binary")


def _flat(keys: pa.Array, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """All digests of a column of packed ones of `width` bytes, and how many each row has."""
    size = pc.binary_length(keys).to_numpy().astype(np.int64) // width
    wide = np.int64 if pa.types.is_large_binary(keys.type) else np.int32
    first = int(np.frombuffer(keys.buffers()[1], wide)[keys.offset]) if len(keys) else 0
    if width == 8:
        return np.frombuffer(keys.buffers()[2] or b"", np.uint64, int(size.sum()), first), size
    whole = np.zeros((int(size.sum()), 8), np.uint8)
    whole[:, :width] = np.frombuffer(keys.buffers()[2] or b"", np.uint8, whole.shape[0] * width, first).reshape(-1, width)
    return whole.view(np.uint64).ravel(), size


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and how many each row has."""
    size = pc.binary_length(column).to_numpy().astype(np.int64)
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = int(np.frombuffer(column.buffers()[1], wide)[column.offset]) if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8, int(size.sum()), first), size


def _fingerprints(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of each row's digests: a bit is 1 if set in over half of them."""
    out = np.zeros(len(size), np.uint64)
    for i, (at, n) in enumerate(zip(np.cumsum(size) - size, size)):
        ones = np.zeros(64, np.int64)
        for lo in range(at, at + n, 4096):
            ones += np.unpackbits(key[lo : min(lo + 4096, at + n)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def _signatures(key: np.ndarray, size: np.ndarray) -> pa.Array:
    """Each row's parity signature: a bit is 1 if an odd number of digests end in its number."""
    least, most = SIGN_BITS
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), least, most)
    at = np.concatenate([[0], np.cumsum(bits)])
    place = np.repeat(at[:-1], size) + (key & (np.repeat(bits, size) - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(bool), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.array(at >> 3, pa.int32()).buffers()[1], pa.py_buffer(packed.tobytes())])


def _differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Bits in which the signatures of each row differ; the longer one is folded to the length of the other."""
    (x, n), (y, m) = (_bytes(c) for c in (a, b))
    out = np.zeros(len(n), np.int64)
    for i, j in set(zip(n.tolist(), m.tolist())):
        rows = np.flatnonzero((n == i) & (m == j))
        p, q = (z[(np.cumsum(k) - k)[rows][:, None] + np.arange(w)] for z, k, w in ((x, n, i), (y, m, j)))
        w = min(i, j)
        p, q = (np.bitwise_xor.reduce(z.reshape(len(rows), -1, w), axis=1) for z in (p, q))
        out[rows] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    return out


def _rarities(sets: DataFrame) -> np.ndarray:
    """Per bucket of shingles, its rarity in steps of a quarter of an octave."""

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            total += np.bincount((_flat(batch.column(0))[0] >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        yield _slices(total)

    slices = sets.select("keys").mapInArrow(count, "slice int, counts binary").withColumn("salt", (F.spark_partition_id() / 256).cast("int"))
    return np.minimum(255, 4 * np.log2(1 + _total(slices, COUNT_BITS))).astype(np.uint8)


def _prefixes(sets: DataFrame, rarity: np.ndarray, threshold: float) -> DataFrame:
    """(doc_id, set, n, fp, keys, sign): the prefix of each row's set, its rarest keys in ascending order, the size of the set, its SimHash and signature."""
    kind = dict(sets.dtypes)["doc_id"]

    def cut(batches):
        for batch in batches:
            key, size = _flat(batch.column(3))
            fp, sign = _fingerprints(key, size), _signatures(key, size)
            row = np.repeat(np.arange(len(size)), size)
            key = rarity[(key >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(_HASH) | key & np.uint64((1 << _HASH) - 1)
            key = key[np.lexsort((key, row))]
            # a set so small that one more or fewer shingle is too many has no partner but its equal
            kept = np.where(size / (size + 1) >= threshold - 1e-9, _prefix(size, threshold), 0)
            key = key[np.repeat(np.cumsum(size) - size, kept) + _ranges(np.zeros(len(size), np.int64), kept)]
            off = pa.array(_KEPT * np.concatenate([[0], np.cumsum(kept)]), pa.int32())
            low = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :_KEPT])
            packed = pa.Array.from_buffers(pa.binary(), len(size), [None, off.buffers()[1], pa.py_buffer(low.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp), packed, sign], ["doc_id", "set", "n", "fp", "keys", "sign"])

    return materialise(sets.mapInArrow(cut, f"doc_id {kind}, set long, n int, fp long, keys binary, sign binary"), "prefixes", **{"parquet.enable.dictionary": "false"})


def _index(prefixes: DataFrame, groups: int) -> DataFrame:
    """(part, n, entries): the entries of prefixes(set, label, n, keys), a row for each group and batch."""

    def split(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            name, label, whole = (batch.column(i).to_numpy() for i in range(3))
            key, size = _flat(batch.column(3), _KEPT)
            row = np.repeat(np.arange(len(size)), size)
            at = _ranges(np.zeros(len(size), np.int64), size)
            part = (mix64(key.copy()) % np.uint64(groups)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            part, row = part[by], row[by]
            columns = dict(key=key[by].astype(np.uint32), set=name[row], label=label[row], n=whole[row].astype(np.int32), at=at[by].astype(np.int32))
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cuts[1:], len(part))
            blobs = [pack.compress(b"".join(columns[c][a:b].tobytes() for c, _ in _ENTRY)) for a, b in zip(cuts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int64()), pa.array((ends - cuts)[: len(cuts)], pa.int64()), pa.array(blobs, pa.binary())], ["part", "n", "entries"])

    return prefixes.select("set", "label", "n", "keys").mapInArrow(split, "part long, n long, entries binary")


def _entries(table: pa.Table) -> dict[str, np.ndarray]:
    """The entries of a group by key, size and set, each once."""
    unpack, found = zstandard.ZstdDecompressor(), {c: [] for c, _ in _ENTRY}
    for n, blob in zip(table.column("n").to_pylist(), table.column("entries")):
        data, at = unpack.decompress(blob.as_py()), 0
        for c, kind in _ENTRY:
            found[c].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    e = {c: np.concatenate(x) for c, x in found.items()}
    by = np.lexsort((e["set"], e["n"], e["key"]))
    e = {c: x[by] for c, x in e.items()}
    new = np.ones(len(by), bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["set"][1:] != e["set"][:-1])
    return {c: x[new] for c, x in e.items()}


def _may(e: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether length and position let pairs of entries reach the threshold."""
    n, m = e["n"][x].astype(np.int64), e["n"][y].astype(np.int64)
    need = np.ceil((n + m) * threshold / (1 + threshold) - 1e-9).astype(np.int64)
    return np.minimum(e["at"][x], e["at"][y]) + np.minimum(n - e["at"][x], m - e["at"][y]) >= need


def _pairs(e: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, times) of pairs of entries, a < b."""
    a, b = np.minimum(e["set"][x], e["set"][y]), np.maximum(e["set"][x], e["set"][y])
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    return a[head], b[head], np.diff(np.append(head, len(a)))


def _alike(prefixes: DataFrame) -> DataFrame:
    """(a, b): pairs of sets whose fingerprints are equal or lie within three bits, for each fingerprint through one set."""
    known = prefixes.where("n > 0").select("fp", "set").distinct()
    nodes = known.groupBy("fp").agg(F.min("set").alias("one"))
    same = known.join(nodes, "fp").select("set", "one")
    met = hub_links(nodes.select("fp"))
    of = lambda s: nodes.select(F.col("fp").alias(s), F.col("one").alias(f"of_{s}"))
    near = met.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("set"), F.col("of_b").alias("one"))
    pairs = same.unionByName(near).where("set <> one").select(F.least("set", "one").alias("a"), F.greatest("set", "one").alias("b"))
    return materialise(pairs.distinct(), "alike")


def _hubs(index: DataFrame, threshold: float) -> DataFrame:
    """(a, b): for each set the HUBS partners that it meets most often as its shingle's hub, the set of the smallest name."""

    def meet(table: pa.Table) -> pa.Table:
        e = _entries(table)
        head = np.flatnonzero(np.diff(e["key"], prepend=~e["key"][:1]) != 0)
        size = np.diff(np.append(head, len(e["key"])))
        first = np.lexsort((e["set"], np.repeat(np.arange(len(head)), size)))[head]
        hub, own = np.repeat(first, size), np.arange(len(e["key"]))
        fit = (hub != own) & _may(e, hub, own, threshold)
        a, b, times = _pairs(e, hub[fit], own[fit])
        return pa.table({"a": a, "b": b, "times": times.astype(np.int64)})

    met = index.groupBy("part").applyInArrow(meet, "a long, b long, times long").groupBy("a", "b").agg(F.sum("times").alias("times"))
    best = met.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "a")), asc=False), 1, HUBS).alias("hubs"))
    return best.select(F.explode("hubs.a").alias("a"), "b")


def _rest(index: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs with different labels that may reach the threshold."""

    def meet(table: pa.Table) -> pa.Table:
        e = _entries(table)
        run = np.cumsum(np.diff(e["key"], prepend=e["key"][:1]) != 0, dtype=np.int64)
        n = e["n"].astype(np.int64)
        top = int(n.max() / threshold) + 2
        reach = np.searchsorted(run * top + n, run * top + np.minimum(np.floor(n / threshold + 1e-9).astype(np.int64), top - 1), side="right")
        size = reach - np.arange(len(n)) - 1
        done = np.cumsum(size)
        a = b = np.zeros(0, np.int64)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
            x, y = np.repeat(np.arange(lo, hi), size[lo:hi]), _ranges(np.arange(lo, hi) + 1, size[lo:hi])
            lo = hi
            fit = (e["label"][x] != e["label"][y]) & _may(e, x, y, threshold)
            p, q, _ = _pairs(e, x[fit], y[fit])
            a, b = np.concatenate([a, p]), np.concatenate([b, q])
        return pa.table({"a": a, "b": b})

    return index.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def _close(pairs: DataFrame, prefixes: DataFrame, threshold: float) -> DataFrame:
    """The pairs(a, b) whose signatures let their sets reach the threshold: most others go before whole sets are shuffled."""

    def check(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            need = np.ceil((n + m) * threshold / (1 + threshold) - 1e-9).astype(np.int64)
            fit = _differing(batch.column(3), batch.column(5)) <= n + m - 2 * need
            yield batch.select(["a", "b"]).filter(pa.array(fit))

    known = prefixes.groupBy("set").agg(F.any_value("n").alias("n"), F.any_value("sign").alias("sign"))
    of = lambda s: shuffled(known.select(F.col("set").alias(s), F.col("n").alias(f"n_{s}"), F.col("sign").alias(f"sign_{s}")))
    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "sign_a", "n_b", "sign_b")
    return met.mapInArrow(check, "a long, b long")


def _real(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs(a, b) whose sets reach the threshold."""
    pairs = materialise(_close(pairs, prefixes, threshold), "pairs")
    wanted = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("set"))
    # before keys are shuffled, a bitmap of fixed size leaves out most sets of no pair
    word = F.shiftrightunsigned("set", 6).bitwiseAND(F.lit((1 << WANTED_BITS - 6) - 1)).alias("word")
    bits = wanted.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(set & 63 as int))")).alias("bits"))
    some = sets.select("set", "keys", word).join(F.broadcast(bits), "word").where(F.getbit("bits", F.col("set").bitwiseAND(F.lit(63)).cast("int")) == 1)
    some = some.groupBy("set").agg(F.first("keys").alias("keys"))

    def check(batches):
        for batch in batches:
            a, b = (batch.column(i) for i in (2, 3))
            fit = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                fit[i] = common >= (len(x) + len(y) - common) * threshold - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(fit))

    met = wanted.join(some, "set").groupBy("a", "b").agg(*(F.first(F.when(F.col("set") == F.col(s), F.col("keys")), ignorenulls=True).alias(f"of_{s}") for s in "ab"))
    real = materialise(met.mapInArrow(check, "a long, b long"), "links")
    drop_table(pairs)
    return real


def near_copies(docs: DataFrame, width: int, threshold: float = THRESHOLD, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, component_id, the smallest doc_id reachable over pairs of at least the threshold.

    Documents with equal sets of shingles are linked, those without words too. A null doc_id keeps its row and never
    becomes a component_id (null only if nothing else is reachable). Other columns are ignored, repeated rows are kept.
    """
    sets = _sets(docs, width)
    prefixes = _prefixes(sets, _rarities(sets), threshold)
    total = prefixes.agg(F.sum(F.floor(F.octet_length("keys") / _KEPT))).first()[0] or 0
    groups = total // group_entries + 1
    alike = _alike(prefixes)
    hubs = _hubs(_index(prefixes.withColumn("label", F.col("set")), groups), threshold)
    near = _real(hubs.unionByName(alike).distinct(), prefixes, sets, threshold)
    first = connected(near)
    labelled = prefixes.join(first, prefixes.set == first.node, "left").select("set", F.coalesce("label", "set").alias("label"), "n", "keys")
    rest = _real(_rest(_index(labelled, groups), threshold), prefixes, sets, threshold)
    labels = connected(near.unionByName(rest))
    firsts = prefixes.groupBy("set").agg(F.min("doc_id").alias("first"))
    joined = firsts.join(labels, firsts.set == labels.node, "left").select("set", "first", F.coalesce("label", "set").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    whole = joined.join(smallest, "label").select("set", "component_id")
    out = materialise(prefixes.select("doc_id", "set").join(whole, "set", "left").select("doc_id", "component_id"), "components")
    for table in (prefixes, alike, near, first, rest, labels):
        drop_table(table)
    return out
