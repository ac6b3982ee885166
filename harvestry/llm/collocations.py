"""Collocations of two or three words per language, from exact n-gram counts over all texts.

Texts are cut into pieces, and equal pieces are counted once with a multiplicity, so that boilerplate costs one piece.
Each task takes the n-grams of its pieces apart, adds up what it has and deals sorted, compressed runs of them to hash
buckets. Three words are only counted where both pairs in them may be frequent, by a bitmap of fixed size over the
frequent pairs' hashes; its false hits cost work alone, as their exact count drops them. In each bucket duckdb adds the runs up: it reads them one after the other and spills its hash table to the
task's spill folder where its memory limit asks for it, so a bucket may be larger than memory. Frequent phrases are
written; candidates then ask for the counts of their parts by lookup requests that are shuffled to the part's row, and
tell their own parts that a longer candidate covers them in the same way.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialise, mix64, word_digests

LONGEST = 3
LEAST = 10
COVERED = 50  # percent of a candidate's occurrences inside a longer one that drop it
TOP = 2000
HELD = 16 << 20  # bytes of distinct pieces that a task holds before it hands them on
CHUNK = 8 << 20  # bytes of pieces whose n-grams are added up together
BUCKET = 2_000_000  # words and pairs of pieces that a bucket aims at, so that its table fits the limit below
MEMORY = "256MB"  # of a bucket's counting; the rest of its table spills
FILTER_BITS = 27  # places of the bitmap of frequent shorter phrases, as a power of two: 16 MB travel to each worker
FOLDS = (1024, 32, 1)  # groups of a language that are ranked by themselves, step by step

#: A-Z fold, `[.,;:!?\x0A-\x0D]` become newlines; between them only spaces and tabs separate words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def _pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, times): the distinct pieces of each language, words joined by one space."""

    def cut(batches):
        held: dict[str, Counter] = {}
        size = 0

        def rows():
            for lang, pieces in held.items():
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(pieces), np.int32)), [lang]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], ["lang", "piece", "times"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                pieces = held.setdefault(lang, Counter())
                for piece in (text.as_py() or "").encode().translate(FOLD).split(b"\n"):
                    words = piece.split()
                    if words:
                        piece = b" ".join(words)
                        pieces[piece] += 1
                        size += len(piece)
                if size > HELD:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(cut, "lang string, piece string, times long").groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def _words(pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of pieces in order, their digests, each word's place among them, and the pieces' lengths in words."""
    split = pc.split_pattern(pieces, " ")
    words = split.flatten().dictionary_encode()
    by = pc.sort_indices(words.dictionary).to_numpy().astype(np.int64)
    vocabulary = words.dictionary.take(pa.array(by))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    off = np.frombuffer(vocabulary.buffers()[1], np.int32)[vocabulary.offset : vocabulary.offset + len(by) + 1].astype(np.int64)
    digest = word_digests(np.frombuffer(vocabulary.buffers()[2], np.uint8), off[:-1], off[1:])
    return vocabulary, digest, rank[words.indices.to_numpy()], pc.list_value_length(split).to_numpy().astype(np.int64)


def _hashes(digest: np.ndarray, begin: np.ndarray, n: int, lang: str) -> np.ndarray:
    """Hashes of the n words from each of begin on; digest: of all words in their order. They deal phrases out and never tell them apart."""
    out = np.full(len(begin), n + (zlib.crc32(lang.encode()) << 8), np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0xD1342543DE82EF95) + digest[begin + i])
    return out


def _grams(pieces: pa.Array, times: np.ndarray, lang: str, lengths: range, frequent: np.ndarray | None):
    """(words, phrases, weights, hashes) of the distinct n-grams of pieces, in the order of their words.

    With a bitmap, n-grams whose first or last n - 1 words are in none of its places are left out.
    """
    vocabulary, digest, ids, size = _words(pieces)
    weight = np.repeat(times, size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(ids))  # words from here to the end of the piece
    spelt = digest[ids]
    for n in lengths:
        fit = np.flatnonzero(left >= n)
        if frequent is not None:
            for shift in (0, 1):
                at = (_hashes(spelt, fit + shift, n - 1, lang) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                fit = fit[frequent[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
        if not len(fit):
            continue
        key = np.zeros(len(fit), np.int64)
        for i in range(n):
            key = key * len(vocabulary) + ids[fit + i]
        by = np.argsort(key, kind="stable")
        found = key[by]
        head = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        first = fit[by[head]]
        taken = [vocabulary.take(pa.array(ids[first + i])) for i in range(n)]
        yield n, pc.binary_join_element_wise(*taken, " ") if n > 1 else taken[0], np.add.reduceat(weight[fit[by]], head), _hashes(spelt, first, n, lang)


def _bitmap(counts: DataFrame, words: int) -> np.ndarray:
    """The places of the hashes of all phrases of so many words; at most 2 ** (FILTER_BITS - 6) numbers reach the driver."""

    def places(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in pc.unique(table.column("lang")):
                own = table.filter(pc.equal(table.column("lang"), lang)).column("phrase").combine_chunks()
                own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
                _, digest, ids, size = _words(own)
                at = _hashes(digest[ids], np.cumsum(size) - size, words, lang.as_py()) >> np.uint64(64 - FILTER_BITS)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    rows = counts.where(F.col("words") == words).select("lang", "phrase").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def _runs(pieces: DataFrame, buckets: int, lengths: range, frequent: np.ndarray | None = None) -> DataFrame:
    """(bucket, lang, words, grams): sorted runs of n-grams with their weights, Arrow streams under zstd."""

    shared = pieces.sparkSession.sparkContext.broadcast(frequent)

    def dealt(table: pa.Table):
        for lang in pc.unique(table.column("lang")):
            own = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
            for n, phrases, total, deal in _grams(own.column("piece").chunk(0), own.column("times").chunk(0).to_numpy(), lang.as_py(), lengths, shared.value):
                bucket = (deal % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
                run = pa.RecordBatch.from_arrays([phrases.take(pa.array(by)), pa.array(total[by])], ["phrase", "times"])
                blobs = []
                for lo, hi in zip(cuts, [*cuts[1:], len(by)]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(run.slice(lo, hi - lo))
                    blobs.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[by][cuts]), pa.array([lang.as_py()] * len(cuts), pa.string()), pa.array([n] * len(cuts), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "lang", "words", "grams"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            # a batch of long pieces may exceed the chunk by far
            step = max(1, batch.num_rows * CHUNK // max(CHUNK, batch.nbytes))
            for lo in range(0, batch.num_rows, step):
                held.append(batch.slice(lo, step))
                size += held[-1].nbytes
                if size >= CHUNK:
                    yield from dealt(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield from dealt(pa.Table.from_batches(held))

    return pieces.mapInArrow(run, "bucket long, lang string, words int, grams binary")


def _counts(runs: DataFrame, buckets: int, least: int) -> DataFrame:
    """(lang, words, phrase, f): n-grams that occur at least `least` times; a partition holds whole buckets."""

    def count(batches):
        import duckdb

        def grams():
            for batch in batches:
                for lang, n, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2)), batch.column(3)):
                    for run in pa.ipc.open_stream(blob.as_buffer()):
                        same = pa.DictionaryArray.from_arrays(pa.array(np.zeros(run.num_rows, np.int32)), [lang]).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([same, pa.array(np.full(run.num_rows, n, np.int32)), *run.columns], schema=schema)

        schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("times", pa.int64())])
        # where Spark's own shuffles spill; the folder goes with the task
        spill = tempfile.mkdtemp(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            con.register("runs", pa.RecordBatchReader.from_batches(schema, grams()))
            found = con.sql(f"select lang, words, phrase, sum(times)::bigint as f from runs group by all having sum(times) >= {int(least)}")
            yield from found.to_arrow_reader(10_000)
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)

    return runs.repartition(buckets, "bucket").mapInArrow(count, "lang string, words int, phrase string, f long")


def _inner(phrase: str, words: int, start: int, n: int):
    return F.substring_index(F.substring_index(phrase, " ", start + n), " ", -n) if start + n < words else F.substring_index(phrase, " ", -n)


def _top(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language, of ever fewer groups of them, so that no task ranks a whole language."""
    for fold in FOLDS:
        order = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(fold))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        scored = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return scored


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, bucket: int = BUCKET) -> DataFrame:
    """Per language of docs(text, lang), the first phrases: lang, rank, phrase, a, l, r, n, score.

    A null lang is `und`, a null or empty text has no words; pieces may be of any length. Rows count as often as they
    stand in docs. Ties go to the larger count, then to the smaller phrase in UTF-8 order. An empty table gives no rows.
    Other columns are ignored.
    """
    pieces = materialise(_pieces(docs), "pieces")
    words = F.char_length("piece") - F.char_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    langs = pieces.groupBy("lang").agg(F.sum(F.col("times") * words).alias("n"), F.sum(words).alias("distinct"))
    total = langs.agg(F.sum("distinct")).first()[0] or 0
    buckets = 2 * total // bucket + 1
    written = [materialise(_counts(_runs(pieces, buckets, range(1, 3)), buckets, least), "phrases")]
    for n in range(3, longest + 1):
        written.append(materialise(_counts(_runs(pieces, buckets, range(n, n + 1), _bitmap(written[-1], n - 1)), buckets, least), "phrases"))
    counts = reduce(DataFrame.unionByName, written)
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    both = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.expr("substring_index(phrase, ' ', k)").alias("part")), F.struct(F.lit("r").alias("side"), F.expr("substring_index(phrase, ' ', k - words)").alias("part")))).alias("ask")
    asks = candidates.select("*", cuts).select("lang", "phrase", "a", "k", both).select("lang", "phrase", "a", "k", "ask.*")
    told = asks.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = {f"{side}{k}": F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))) for k in range(1, longest) for side in "lr"}
    told = told.groupBy("lang", "phrase", "a").agg(*(x.alias(name) for name, x in sides.items()))
    cut = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(cast(1000000 as decimal(7, 0)) * (cast(a as decimal(19, 0)) * a)) div (cast(l{k} as decimal(19, 0)) * r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    scored = told.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*cut))).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = None
    for m in range(3, longest + 1):
        subs = F.explode(F.array_distinct(F.array(*(_inner("phrase", m, s, n) for n in range(2, m) for s in range(m - n + 1))))).alias("phrase")
        found = candidates.where(F.col("words") == m).select("lang", subs, "a")
        inner = found if inner is None else inner.unionByName(found)
    if inner is not None:
        cover = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        scored = scored.join(cover, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {COVERED} * a").drop("longer")
    best = _top(scored, top).join(langs.select("lang", "n"), "lang")
    out = materialise(best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    for table in (pieces, *written):
        drop_table(table)
    return out


ORACLE = r"""
    with t as (select coalesce(lang, 'und') as lang, row_number() over () as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from t)),
    g as (select lang, k, array_to_string(ws[s:s + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as s from p, (values (1), (2), (3)) as v(k) where len(ws) >= k)),
    f as (select lang, k, phrase, count(*) as f from g group by all),
    n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
    c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 10),
    cut as (select *, array_to_string(ws[:j], ' ') as p1, array_to_string(ws[j + 1:], ' ') as p2 from (select *, unnest(range(1, k)) as j from c)),
    s as (select cut.lang, cut.phrase, a, j, x.f as l, y.f as r, (1000000::hugeint * a * a // (x.f::hugeint * y.f))::bigint as score
          from cut join f x on x.lang = cut.lang and x.phrase = p1 join f y on y.lang = cut.lang and y.phrase = p2),
    m as (select *, row_number() over (partition by lang, phrase order by score, j) as best from s),
    inner_phrases as (select lang, array_to_string(ws[1:2], ' ') as phrase, a from c where k = 3 union all select lang, array_to_string(ws[2:3], ' '), a from c where k = 3),
    dropped as (select distinct c.lang, c.phrase from c join inner_phrases i on c.lang = i.lang and c.phrase = i.phrase where 100 * i.a >= 50 * c.a),
    r as (select m.lang, row_number() over (partition by m.lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from m join n on m.lang = n.lang anti join dropped d on m.lang = d.lang and m.phrase = d.phrase where best = 1)
    select * from r where rank <= 2000"""
