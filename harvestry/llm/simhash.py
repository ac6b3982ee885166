"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint maps to 32 coordinates, the popcounts of its two-bit segments, held as a thermometer code (00, 01,
11), so that the Manhattan distance of two embeddings is one xor and one popcount. It never exceeds the Hamming
distance. Pairs within distance 3 lie within Manhattan distance 3, hence one half of the coordinates (16 of them) lies
within distance 1: the grid range-join meets each half's cell with itself and with the cells one step above it. The
Manhattan bound over all coordinates and then the Hamming distance decide. A first round meets each fingerprint with four
of each cell only, the second all pairs that these links left in different components: a dense ball of distinct
fingerprints so gives rows that grow with its size. Components come from minimum labels with pointer jumping over the
links between distinct fingerprints; all tables stay distributed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, shuffled

SEED = 42
MAX_BITS = 3


def _kernel(width: int):
    def run(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().lower().split()
                if not words:
                    continue
                shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else (b" ".join(words),)
                n = max(1, len(words) - width + 1)
                h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
                ones = np.zeros(64, np.int64)
                for lo in range(0, n, 4096):
                    part = h[lo : lo + 4096].view(np.uint8).reshape(-1, 8)
                    ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[i] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): SimHash over `width`-word shingles of lower-cased (A-Z) words, repeats included; fp is signed.

    Fewer words: their whole sequence; a null or empty text: zero.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_kernel(width), f"doc_id {kind}, fp long")


def thermometer(fp) -> F.Column:
    """The embedding: per two-bit segment, 00, 01 or 11 for no, one or two bits set."""
    low = F.lit(0x5555555555555555)
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def _cells(nodes: DataFrame) -> DataFrame:
    """(fp, label, code, half, cell): each node in the cells of both halves of its coordinates."""
    code = thermometer(F.col("fp"))
    both = F.array(F.struct(F.lit(0).alias("half"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("code", 32).alias("cell")))
    return nodes.select("fp", "label", code.alias("code")).select("fp", "label", "code", F.explode(both).alias("h")).select("fp", "label", "code", "h.half", "h.cell")


def _probes(cells: DataFrame) -> DataFrame:
    """(fp2, label2, code2, half, cell, same): each node in its cells and in those one step above."""
    # a step up sets a segment's low bit (00 to 01) or its high bit where the low one is set (01 to 11)
    step = F.expr("shiftleft(1L, bit)")
    unset = F.col("cell").bitwiseAND(step) == 0
    low_set = (F.col("bit") % 2 == 0) | (F.col("cell").bitwiseAND(F.expr("shiftrightunsigned(shiftleft(1L, bit), 1)")) != 0)
    steps = cells.select("*", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("bit")).where((F.col("bit") < 0) | (unset & low_set))
    cell = F.when(F.col("bit") < 0, F.col("cell")).otherwise(F.col("cell").bitwiseOR(step)).alias("cell")
    return steps.select(F.col("fp").alias("fp2"), F.col("label").alias("label2"), F.col("code").alias("code2"), "half", cell, (F.col("bit") < 0).alias("same"))


def _near(x: str, y: str, max_bits: int):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= max_bits


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp, unique) with Hamming distance of at most max_bits (3 at most).

    Where nodes have a label, only pairs of different labels.
    """
    if max_bits > 3:
        raise ValueError("two halves cover distances up to 3")
    cells = _cells(nodes if "label" in nodes.columns else nodes.withColumn("label", F.col("fp")))
    fit = (F.col("label") != F.col("label2")) & _near("code", "code2", max_bits) & _near("fp", "fp2", max_bits)
    met = cells.join(shuffled(_probes(cells)), ["half", "cell"]).where((~F.col("same") | (F.col("fp") < F.col("fp2"))) & fit)
    return met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"), F.least("label", "label2").alias("la"), F.greatest("label", "label2").alias("lb"))


def hub_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Some pairs a < b of links(nodes): those with four of each cell's nodes, so that rows grow with the number of nodes."""
    cells = _cells(nodes.withColumn("label", F.col("fp")))
    order = F.xxhash64("fp")
    hubs = cells.groupBy("half", "cell").agg(F.min("fp").alias("h1"), F.max("fp").alias("h2"), F.min(F.struct(order, "fp")).getField("fp").alias("h3"), F.max(F.struct(order, "fp")).getField("fp").alias("h4"))
    met = _probes(cells).join(shuffled(hubs), ["half", "cell"]).select("fp2", F.explode(F.filter(F.array_distinct(F.array("h1", "h2", "h3", "h4")), lambda h: (h != F.col("fp2")) & (F.bit_count(h.bitwiseXOR(F.col("fp2"))) <= max_bits))).alias("h"))
    return met.select(F.least("fp2", "h").alias("a"), F.greatest("fp2", "h").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for nodes of edges(a, b)."""
    both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        heard = both.join(shuffled(labels), both.u == labels.node).groupBy("v").agg(F.min("label").alias("heard"))
        near = labels.join(shuffled(heard), labels.node == heard.v, "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        new = near.join(shuffled(jump), near.label == jump.via, "left").select("node", "old", F.least("label", "beyond").alias("label"))
        new = materialise(new, "labels")
        done = new.where("label <> old").isEmpty()
        drop_table(labels)
        labels = new.select("node", "label")
        if done:
            drop_table(both)
            return labels


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most max_bits differing bits; rows with equal
    fingerprints are linked. Nulls: a null text has fingerprint zero; a null doc_id keeps its row and never becomes a
    component_id (null only if nothing else is reachable). Other columns are ignored, repeated rows are kept.
    """
    fp = materialise(fingerprints(docs, width), "fingerprints")
    nodes = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    near = components(hub_links(nodes.select("fp"), max_bits))
    labelled = materialise(nodes.join(shuffled(near), nodes.fp == near.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    rest = components(links(labelled.select("fp", "label"), max_bits).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    joined = labelled.join(shuffled(rest.select("node", F.col("label").alias("root"))), labelled.label == rest.node, "left").select("fp", "first", F.coalesce("root", "label").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    whole = joined.join(shuffled(smallest), "label").select("fp", "component_id")
    out = fp.join(shuffled(whole), "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    out = materialise(out, "components")
    for table in (fp, nodes, near, labelled, rest):
        drop_table(table)
    return out
