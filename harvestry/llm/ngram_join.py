"""Near-duplicates by the Jaccard similarity of word n-gram sets, joined through a vertical partitioning.

All n-grams have one global order, rarest first, which pivots cut into fragments of equal mass. A set is thereby cut
into segments, one in each fragment. Sets that can reach the threshold share an n-gram of their prefixes, which gives
candidate pairs; the segments of candidates are dealt to (fragment, block of pairs), where each pair's overlap within
the fragment is counted by itself, and the sum of a pair's partial overlaps decides. A segment whose difference alone
rules its pair out adds nothing.

Equal sets are one node. In the first round each node meets the hubs of its prefix n-grams only (for each n-gram a few
of its nodes), in the last all nodes that these links left in other components, one side being those outside the
n-gram's largest component; so a large group of near copies makes rows in proportion to its size. Blocks hold a bounded
number of n-grams, a node with many partners is dealt to many blocks, and nothing is joined by documents of equal text.
N-grams are told apart by 56 bits, which matters within a pair of documents alone, and sets by 128 bits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, mix64, text_chunks, word_bounds, word_digests
from .near_copies import CHUNK, COUNT_BITS, _flat, _ranges, _sets, _slices, _total
from .simhash import components

WIDTH = 4
PERCENT = 85
FRAGMENTS = 8
TURNS = 1  # rounds in which nodes meet hubs alone
SEEDS = 4  # hubs of an n-gram
HUBS = 8  # partners of a node in such a round
BLOCK = 2_000_000  # n-grams of pairs that a block aims at
WANTED_BITS = 24  # places of the bitmap that leaves out sets of no pair: at most 2 ** (WANTED_BITS - 6) rows of 16 bytes are broadcast
_HASH = 56  # bits of a key below its rarity


def _packed(keys: np.ndarray, size: np.ndarray) -> pa.Array:
    off = pa.array(8 * np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(size), [None, off.buffers()[1], pa.py_buffer(keys.tobytes())])


def _ordered(key: np.ndarray, size: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Keys that sort in the global order, ascending within each row; the digests ascend in each row already."""
    rare = rarity[(key >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    out = rare.astype(np.uint64) << np.uint64(_HASH) | key >> np.uint64(64 - _HASH)
    done = np.concatenate([[0], np.cumsum(size)])
    for lo in range(0, len(size), 256):  # so that row and rarity are 16 bits, which sort in linear time
        hi = min(lo + 256, len(size))
        a, b = done[lo], done[hi]
        place = np.repeat(np.arange(hi - lo, dtype=np.uint16), size[lo:hi]) << np.uint16(8) | rare[a:b]
        out[a:b] = out[a:b][np.argsort(place, kind="stable")]
    return out


def _counts(docs: DataFrame, width: int) -> np.ndarray:
    """Per bucket of shingles, the rarity of its occurrences in steps of a quarter of an octave; as digests of _sets."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, rows, raw, off in text_chunks(batch, limit=CHUNK):
                raw = lower[raw]
                starts, ends, at = word_bounds(raw, off)
                digest = word_digests(raw, starts, ends)
                key = np.full(max(0, len(digest) - width + 1), width, np.uint64)
                for k in range(width):
                    key = mix64(key * np.uint64(0xD1342543DE82EF95) + digest[k : k + len(key)])
                inside = np.ones(len(key) + 1, bool)
                for k in range(1, width):  # not across two texts
                    inside[np.clip(at[1:-1] - k, 0, len(key))] = False
                total += np.bincount((key[inside[:-1]] >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        yield _slices(total)

    slices = docs.select("text").mapInArrow(count, "slice int, counts binary").withColumn("salt", (F.spark_partition_id() / 256).cast("int"))
    return np.minimum(255, 4 * np.log2(1 + _total(slices, COUNT_BITS))).astype(np.uint8)


def _second(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Another 64 bits of a set's name."""
    name = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        name[some] = mix64(np.add.reduceat(mix64(key * np.uint64(0xA24BAED4963EE407) + np.uint64(7)), np.cumsum(size[some]) - size[some]))
    return name.view(np.int64)


def _pivots(rarity: np.ndarray, fragments: int) -> np.ndarray:
    """Where fragments begin, so that each has about the same share of all n-grams, by the counts behind the rarities."""
    mass = np.bincount(rarity, weights=2.0 ** (rarity / 4) - 1, minlength=256)
    done = np.concatenate([[0], np.cumsum(mass)])
    want = done[-1] * np.arange(1, fragments) / fragments
    step = np.searchsorted(done[1:], want)
    within = np.clip((want - done[step]) / np.maximum(mass[step], 1e-9), 0, 1 - 1e-9)
    return np.unique((step.astype(np.uint64) << np.uint64(_HASH)) + (within * (1 << _HASH)).astype(np.uint64))


def _prefixes(sets: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, h1, h2, n, keys): a name of each row's set and its prefix in the global order."""
    kind = dict(sets.dtypes)["doc_id"]

    def cut(batches):
        for batch in batches:
            key, size = _flat(batch.column(3))
            second = _second(key, size)
            key = _ordered(key, size, rarity)
            # a set so small that one more or fewer is too many has no partner but its equal
            kept = np.where(100 * size >= percent * (size + 1), size + (-percent * size // 100) + 1, 0)
            key = key[np.repeat(np.cumsum(size) - size, kept) + _ranges(np.zeros(len(size), np.int64), kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(second), batch.column(2), _packed(key, kept)], ["doc_id", "h1", "h2", "n", "keys"])

    return sets.mapInArrow(cut, f"doc_id {kind}, h1 long, h2 long, n int, keys binary")


def _entries(nodes: DataFrame) -> DataFrame:
    """(key, node, n, at): the prefix n-grams of each node and their places in it."""

    def split(batches):
        for batch in batches:
            key, size = _flat(batch.column(2))
            row = np.repeat(np.arange(len(size)), size)
            node, n = batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node, n, pa.array(_ranges(np.zeros(len(size), np.int64), size), pa.int32())], ["key", "node", "n", "at"])

    return nodes.select("node", "n", "keys").mapInArrow(split, "key long, node long, n int, at int")


def _may(percent: int, x: tuple[str, str] = ("n", "at"), y: tuple[str, str] = ("n2", "at2")):
    """Whether sizes and places let two entries' sets reach the threshold: an overlap of percent / (100 + percent) of both sizes."""
    (n, at), (m, to) = (map(F.col, z) for z in (x, y))
    return (F.least(at, to) + F.least(n - at, m - to)).cast("long") * (100 + percent) >= (n + m).cast("long") * percent


def _shared(nodes: DataFrame, percent: int) -> DataFrame:
    """The entries of n-grams that several nodes have in their prefixes: (key, node, n, at, private), private: entries of the node that no other has."""
    entries = _entries(nodes)
    several = entries.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1").drop("nodes")
    met = materialise(entries.join(several, "key").select("key", "node", "n", "at"), "met", **{"parquet.enable.dictionary": "false"})
    prefix = F.col("n") - F.ceil(F.col("n").cast("long") * percent / 100) + 1
    counts = met.groupBy("node", "n").agg(F.count("*").alias("shared")).select("node", (prefix - F.col("shared")).alias("private"))
    out = materialise(met.join(counts, "node"), "shared", **{"parquet.enable.dictionary": "false"})
    drop_table(met)
    return out


def _could(percent: int, times: str = "times"):
    """Whether two sets that share so many prefix n-grams can reach the threshold: of one set, all that the other has are in both prefixes or behind its own."""
    behind = lambda n: F.ceil(F.col(n).cast("long") * percent / 100) - 1
    return (F.col(times) + F.greatest(behind("na"), behind("nb"))) * (100 + percent) >= (F.col("na").cast("long") + F.col("nb")) * percent


def _hub_pairs(shared: DataFrame, percent: int, seed: int) -> DataFrame:
    """(a, na, b, nb), a < b: each node and those hubs with another label that it meets most often.

    shared(key, node, n, at, private, label). An n-gram has SEEDS hubs, of as many classes of nodes, which are dealt anew
    by seed: each the node with the fewest n-grams of its own, as an edit makes those, so that the text that copies come
    from is among them.
    """
    part = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(SEEDS))
    order = F.shiftleft(F.greatest("private", F.lit(0).cast("long")), 32) + F.pmod(F.xxhash64("node", F.lit(-1 - seed)), F.lit(1 << 32))
    firsts = shared.groupBy("key").agg(*(F.min(F.when(part == i, order)).alias(f"first{i}") for i in range(SEEDS)))
    is_hub = F.lit(False)
    for i in range(SEEDS):
        is_hub = is_hub | ((part == i) & (order == F.col(f"first{i}")))
    hubs = shared.join(firsts, "key").where(is_hub).select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("label").alias("label2"))
    met = shared.join(hubs, "key").where((F.col("label") != F.col("label2")) & _may(percent)).groupBy("node", F.col("n").alias("na"), "node2", F.col("n2").alias("nb")).agg(F.count("*").alias("times"))
    best = met.where(_could(percent)).groupBy("node", "na").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "node2", "nb")), asc=False), 1, HUBS).alias("hubs"))
    return _in_order(best.select("node", F.col("na").alias("n"), F.explode("hubs").alias("h")).select("node", "n", F.col("h.node2").alias("node2"), F.col("h.nb").alias("n2"))).distinct()


def _in_order(pairs: DataFrame) -> DataFrame:
    first = F.col("node") < F.col("node2")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return pairs.select(pick("node", "node2", "a"), pick("n", "n2", "na"), pick("node2", "node", "b"), pick("n2", "n", "nb"))


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of shared whose n-gram is in several components, with labels and the n-gram's largest component: (key, node, n, at, private, label, largest)."""
    known = labels.select(F.col("node").alias("labelled"), F.col("label").alias("known"))
    labelled = shared.join(known, F.col("node") == F.col("labelled"), "left").select("key", "node", "n", "at", "private", F.coalesce("known", "node").alias("label"))
    labelled = materialise(labelled, "labelled", **{"parquet.enable.dictionary": "false"})
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("nodes"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("nodes", "label")).getField("label").alias("largest")).where("labels > 1").drop("labels")
    out = materialise(labelled.join(mixed, "key"), "open", **{"parquet.enable.dictionary": "false"})
    drop_table(labelled)
    return out


def _other_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, na, b, nb), a < b: all pairs with different labels that may reach the threshold by the first n-gram they share; entries of _open.

    What both have stands behind that first one, so that it lies in a prefix which is as short as the two sizes allow.
    The smaller set's is about half of the whole prefix: only such entries are looked up. Of the pairs so found, all that
    both prefixes share is then counted, which rules most of them out.
    """
    small = entries.where((F.col("n") - F.col("at")).cast("long") * (100 + percent) >= F.col("n").cast("long") * 2 * percent).select("key", "node", "n", "at", "label", "largest")
    other = entries.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("label").alias("label2"), (F.col("label") == F.col("largest")).alias("large"))
    left = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")).cast("long")
    reaches = (F.col("n") <= F.col("n2")) & (left * (100 + percent) >= (F.col("n") + F.col("n2")).cast("long") * percent)
    fit = (F.col("label") != F.col("label2")) & reaches
    # one of the two is outside the n-gram's largest component
    met = small.where("label <> largest").join(other, "key").where(fit).unionByName(small.where("label = largest").join(other.where("not large"), "key").where(fit))
    pairs = materialise(_in_order(met).distinct(), "met")
    side = lambda x: entries.select(F.col("node").alias(x), "key", F.col("at").alias(f"at_{x}"))
    counted = pairs.join(side("a"), "a").join(side("b"), ["b", "key"]).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("times"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    # what both have is counted up to the last that they share, and no more than either has left stands behind it
    behind = F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b")) - 1
    kept = _could(percent) & ((F.col("times") + behind) * (100 + percent) >= (F.col("na").cast("long") + F.col("nb")) * percent)
    out = materialise(counted.where(kept).select("a", "na", "b", "nb"), "others")
    drop_table(pairs)
    return out


def _segments(sets: DataFrame, nodes: DataFrame, pairs: DataFrame, rarity: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(node, fragment, keys): the segments of all nodes of pairs(a, b)."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(asked.join(nodes.select("node", "h1", "h2"), "node"), "wanted")
    # before sets are shuffled, a bitmap of fixed size leaves out most that no pair needs
    word = F.shiftrightunsigned("h1", 6).bitwiseAND(F.lit((1 << WANTED_BITS - 6) - 1)).alias("word")
    bits = wanted.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(h1 & 63 as int))")).alias("bits"))
    place = F.col("h1").bitwiseAND(F.lit(63)).cast("int")
    some = sets.select(F.col("set").alias("h1"), "keys", F.shiftrightunsigned("set", 6).bitwiseAND(F.lit((1 << WANTED_BITS - 6) - 1)).alias("word")).join(F.broadcast(bits), "word").where(F.getbit("bits", place) == 1).select("h1", "keys")

    def named(batches):
        for batch in batches:
            key, size = _flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_second(key, size)), batch.column(1)], ["h1", "h2", "keys"])

    once = some.mapInArrow(named, "h1 long, h2 long, keys binary").groupBy("h1", "h2").agg(F.first("keys").alias("keys"))

    def cut(batches):
        for batch in batches:
            key, size = _flat(batch.column(1))
            row = np.repeat(np.arange(len(size)), size)
            key = _ordered(key, size, rarity)
            part = row * (len(pivots) + 1) + np.searchsorted(pivots, key, side="right")
            head = np.flatnonzero(np.diff(part, prepend=-1))
            count = np.diff(np.append(head, len(part)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part[head] // (len(pivots) + 1))), pa.array(part[head] % (len(pivots) + 1), pa.int32()), _packed(key, count)], ["node", "fragment", "keys"])

    cuts = once.join(wanted, ["h1", "h2"]).select("node", "keys").mapInArrow(cut, "node long, fragment int, keys binary")
    out = materialise(cuts, "segments", **{"parquet.enable.dictionary": "false"})
    drop_table(wanted)
    return out


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs(a, na, b, nb) whose sets reach the threshold, (a, b), written."""
    total = pairs.agg(F.sum((F.col("na") + F.col("nb")).cast("long"))).first()[0] or 0
    blocks = total // block + 1
    # a node's partners go to one block, those of a node with many to as many as their n-grams fill
    degree = pairs.groupBy("a").agg((F.sum((F.col("na") + F.col("nb")).cast("long")) / block + 1).cast("long").alias("parts"))
    dealt = pairs.join(degree, "a").select("a", "na", "b", "nb", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), "parts")), F.lit(blocks)).alias("block"))
    dealt = materialise(dealt, "dealt")
    where = dealt.select(F.col("block").alias("at_block"), F.explode(F.array("a", "b")).alias("node")).distinct()
    there = where.join(segments, "node").select(F.col("at_block").alias("block"), "fragment", "node", "keys")
    each = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        """The partial overlaps of a block's pairs in one fragment."""
        right = right.combine_chunks()
        if not right.num_rows or not left.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "na": pa.array([], pa.int32()), "b": pa.array([], pa.int64()), "nb": pa.array([], pa.int32()), "common": pa.array([], pa.int64())})
        node = right.column("node").to_numpy()
        by = np.argsort(node)
        key, size = _flat(right.column("keys").chunk(0))
        begin = (np.cumsum(size) - size)[by]
        node, size = node[by], size[by]
        a, b = (left.column(c).to_numpy() for c in "ab")
        limit = _slack(left.column("na").to_numpy().astype(np.int64), left.column("nb").to_numpy().astype(np.int64), percent)
        place = [np.minimum(np.searchsorted(node, x), len(node) - 1) for x in (a, b)]
        common = np.zeros(len(a), np.int64)
        for i in np.flatnonzero((node[place[0]] == a) & (node[place[1]] == b)):
            x, y = (key[begin[p[i]] : begin[p[i]] + size[p[i]]] for p in place)
            if abs(len(x) - len(y)) <= limit[i]:
                # both ascend and hold each key once
                at = np.searchsorted(x, y)
                common[i] = np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)
                if len(x) + len(y) - 2 * common[i] > limit[i]:
                    common[i] = 0
        return left.select(["a", "na", "b", "nb"]).append_column("common", pa.array(common)).filter(pa.array(common > 0))

    partial = each.groupBy("block", "fragment").cogroup(there.groupBy("block", "fragment")).applyInArrow(count, "a long, na int, b long, nb int, common long")
    summed = partial.groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
    real = materialise(summed.where(f"100 * common >= {percent} * (cast(na as long) + nb - common)").select("a", "b"), "links")
    drop_table(dealt)
    return real


def _slack(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The most n-grams that two sets that reach the threshold do not share."""
    need = -(-percent * (n + m) // (100 + percent))
    return n + m - 2 * need


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id reachable over links.

    Two documents link when 100 times the intersection of their sets of `width`-word shingles is at least percent times
    the union; rows with equal sets are linked. Fewer words are one shingle; without words (a null text too) the set is
    empty and the row's component is its own doc_id. A null doc_id keeps its row and never becomes a component_id (null
    only if nothing else is reachable). Repeated rows are kept, other columns ignored; an empty table gives no rows.
    """
    sets = _sets(docs, width)
    rarity = _counts(docs, width)
    rows = materialise(_prefixes(sets, rarity, percent), "prefixes", **{"parquet.enable.dictionary": "false"})
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("doc_id").alias("first"))
    # written, as the numbers have to stay the same
    nodes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "nodes", **{"parquet.enable.dictionary": "false"})
    shared = _shared(nodes, percent)
    pivots = _pivots(rarity, FRAGMENTS)

    def linked(pairs: DataFrame) -> DataFrame:
        segments = _segments(sets, nodes, pairs, rarity, pivots)
        real = _overlaps(pairs, segments, percent, block)
        drop_table(pairs)
        drop_table(segments)
        return real

    entries, links = shared.withColumn("label", F.col("node")), []
    for turn in range(TURNS + 1):
        links.append(linked(materialise(_hub_pairs(entries, percent, turn), "hubs") if turn < TURNS else _other_pairs(entries, percent)))
        labels = components(reduce(DataFrame.unionByName, links))
        if turn:
            drop_table(entries)
        if turn < TURNS:
            entries = _open(shared, labels)
            drop_table(labels)
    drop_table(shared)
    joined = nodes.select("h1", "h2", "first", "node").join(labels.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left").select("h1", "h2", "first", F.coalesce("label", "node").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    whole = joined.join(smallest, "label").select("h1", "h2", "component_id")
    found = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "h1", "h2").join(whole, ["h1", "h2"], "left")
    out = materialise(found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "components")
    for table in (rows, nodes, *links, labels):
        drop_table(table)
    return out
