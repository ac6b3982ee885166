"""Best-fit packing after Martello-Toth dominance reduction.

Packing depends on piece lengths alone, and there are at most `capacity` of these, so the instance is a histogram whose
size doesn't follow the corpus. The reduction fixes sets that dominate every other set holding their largest piece: a
piece that nothing fits beside, two pieces that fill a sequence, and a piece with the largest partner that fits, where no
two other pieces beside it are longer than that partner. Best-fit decreasing packs the rest, many equal sequences at a
step. The plan is a table of runs: pieces of one length, by rank, to consecutive sequences. Ranks come from sorting small
hash buckets of a length and from the buckets' running counts, so a length that a third of all pieces have is spread.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_bounds, word_digests

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 300_000  # distinct words that a task's tokenizer remembers at once
CALL = 128  # texts that it encodes at once


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: int) -> int:
        self[key] = n = len(self)
        return n


def _merger(spec: dict):
    """A function from the UTF-8 bytes of a piece to its ids: the file's merges, in their order, run by tiktoken.

    The end-of-word suffix becomes the byte FF, which no UTF-8 text holds; joining it to the byte before ranks first.
    """
    import tiktoken

    vocabulary, suffix = spec["vocab"], spec["end_of_word_suffix"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level files show these bytes as themselves, the others from U+0100
    sign = dict(zip([*shown, *(b for b in range(256) if b not in set(shown))], map(chr, [*shown, *range(256, 512)])))
    byte = {c: b for b, c in sign.items()}
    end = b"\xff"

    def raw(token: str) -> bytes:
        return bytes(byte[c] for c in token.removesuffix(suffix)) + end * token.endswith(suffix)

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + end: 256 + b for b in range(255)}
    ids = [vocabulary[sign[b]] for b in range(255)] + [-1] + [vocabulary[sign[b] + suffix] for b in range(255)]
    for left, right in (m if isinstance(m, list) else m.split(" ") for m in spec["merges"]):
        ranks[raw(left + right)] = len(ids)
        ids.append(vocabulary[left + right])
    if len(ranks) != len(ids):
        raise ValueError("two merges make one token")
    merge = tiktoken.Encoding("pieces", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda piece: [ids[r] for r in merge(piece + end)]


class WordTokenizer:
    """Ids of a word-level BPE file of `tokenizers`, exact, with a bounded memory of words.

    The file's pre-tokenizer never joins what white space separates, nor a letter and another sign after it, and its model
    encodes piece by piece. So text is cut there, and the ids of what stands between are looked up by a 64-bit digest.
    Texts with characters beyond ASCII and the Latin letters up to U+017F, or with added tokens, go through the library as
    a whole: normalisation could join or move their characters.
    """

    #: Bytes of UTF-8 that only texts for the library have: control characters and what starts characters beyond U+017F or below U+00C0.
    OTHER = np.array([b < 9 or 13 < b < 32 or b == 127 or 0xC0 <= b < 0xC3 or b > 0xC5 for b in range(256)])
    LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])

    def __init__(self, path: str):
        import json
        import re

        import regex

        self.path, self.library = path, None
        with open(path) as f:
            spec = json.load(f)
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        added = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        self.other = re.compile(rf"[^\t-\r\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]|{added}").search
        self.merge = _merger(spec["model"])
        self._clear()

    def whole(self, text: str) -> np.ndarray:
        """Ids by the library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _clear(self):
        self.number, self.known = _Numbers(), 0
        self.start = np.zeros(CACHE_WORDS + 1, np.int64)
        self.ids = np.zeros(8 * CACHE_WORDS, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        """Encode words; the memory has room for them."""
        ids: list[int] = []
        ends = []
        for word in new:
            text = word.decode()
            if text.isalpha():
                ids += self.merge(word)
            else:
                for piece in self.pieces(text):
                    ids += self.merge(piece.encode())
            ends.append(len(ids))
        k, base = self.known, int(self.start[self.known])
        while base + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[base : base + len(ids)] = ids
        self.start[k + 1 : k + 1 + len(new)] = base + np.array(ends)
        self.known += len(new)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the texts of a call learn their new words together."""
        data = "\n".join(texts).encode()
        suspect = self.OTHER[np.frombuffer(data, np.uint8)].any() or any(x in data for x in (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", *self.added))
        other = {i for i, t in enumerate(texts) if self.other(t)} if suspect else set()
        lower = [b"" if i in other else t.lower().encode() for i, t in enumerate(texts)]
        data = b"".join(lower)
        raw, off = np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, lower)])
        starts, ends, at = word_bounds(raw, off, letter=self.LETTER)
        digests, first, word = np.unique(word_digests(raw, starts, ends), return_index=True, return_inverse=True)
        keys = digests.tolist()
        if len(self.number) + sum(k not in self.number for k in keys) > CACHE_WORDS:
            self._clear()
        if len(digests) > CACHE_WORDS:
            if len(texts) > 1:
                half = len(texts) // 2
                return self(texts[:half]) + self(texts[half:])
            return [self.whole(texts[0])]
        number = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(digests))
        new = first[number >= self.known]
        if len(new):
            self._learn([data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        n = number[word]
        a = self.start[n]
        size = self.start[n + 1] - a
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(a - stop + size, size) + np.arange(stop[-1])] if len(n) else np.zeros(0, np.uint32)
        cuts = np.append(0, stop)[at]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in other:
            out[i] = self.whole(texts[i])
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text): a document's ids, then END_ID, cut only if longer than capacity."""
    kind = dict(docs.dtypes)["doc_id"]

    def encoded(encode, column):
        for lo in range(0, len(column), CALL):
            yield from encode([t or "" for t in column.slice(lo, CALL).to_pylist()])

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = WordTokenizer(tokenizer)
        for batch in batches:
            rows = []
            for row, ids in enumerate(encoded(encode, batch.column(1))):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    rows.append((row, k, s, len(part), zlib.crc32(part.tobytes())))
            row, k, s, n, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(s), pa.array(n), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces a sequence, offset of the first) for a histogram of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    rank = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(size: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((size, int(rank[size]), int(rank[size] + n), first, per, offset))
        rank[size] += n
        left[size] -= n

    def there(limit: int, but: int = 0) -> list[int]:
        """The three shortest lengths left, repeats included, one of `but` set aside."""
        out: list[int] = []
        for s in np.flatnonzero(left[: limit + 1]).tolist():
            out += [s] * min(3, int(left[s]) - (s == but))
            if len(out) >= 3:
                break
        return out[:3]

    changed = True
    while changed:  # Martello and Toth's reduction
        changed = False
        for size in np.flatnonzero(left)[::-1].tolist():
            while left[size]:
                room = capacity - size
                small = there(room, size)
                if not small:
                    n = int(left[size])
                    put(size, n, bins, 1, 0)
                    bins += n
                elif left[room] - (room == size) > 0:
                    n = int(left[size]) // 2 if room == size else int(min(left[size], left[room]))
                    if room == size:
                        put(size, 2 * n, bins, 2, 0)
                    else:
                        put(size, n, bins, 1, 0)
                        put(room, n, bins, 1, size)
                    bins += n
                else:
                    fits = np.flatnonzero(left[: room + 1])
                    mate = int(fits[-1]) if not (fits[-1] == size and left[size] < 2) else int(fits[-2]) if len(fits) > 1 else 0
                    two_more = len(small) > 1 and small[0] + small[1] <= room
                    three_more = len(small) > 2 and sum(small) <= room
                    if not mate or three_more or two_more and _best_pair(left, room, size) > mate:
                        break
                    n = int(left[size]) // 2 if mate == size else int(min(left[size], left[mate]))
                    if mate == size:
                        put(size, 2 * n, bins, 2, 0)
                    else:
                        put(size, n, bins, 1, 0)
                        put(mate, n, bins, 1, size)
                    bins += n
                changed = True

    open_: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, number)]
    rooms: list[int] = []

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for size in np.flatnonzero(left)[::-1].tolist():  # best-fit decreasing
        while left[size]:
            c = int(left[size])
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                room, first, n = capacity, bins, -(-c // per)
                bins += n
            else:
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                per = room // size
            whole = min(n, c // per)
            if whole:
                put(size, whole * per, first, per, capacity - room)
                give(room - per * size, first, whole)
            rest = c - whole * per
            if rest and whole < n:
                part = min(rest, per)
                put(size, part, first + whole, part, capacity - room)
                give(room - part * size, first + whole, 1)
                whole += 1
            if whole < n:
                give(room, first + whole, n - whole)
    return runs


def _best_pair(left: np.ndarray, room: int, aside: int) -> int:
    """The largest sum of two pieces' lengths that fits into room, one piece of length `aside` set aside."""
    best = 0
    have = left.copy()
    have[aside] -= 1
    sizes = np.flatnonzero(have[: room + 1] > 0)
    lo, hi = 0, len(sizes) - 1
    while lo <= hi:
        s = int(sizes[lo] + sizes[hi])
        if s > room:
            hi -= 1
        else:
            if lo < hi or have[sizes[lo]] > 1:
                best = max(best, s)
            lo += 1
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces(): sequences hold at most capacity ids, gapless from 0.

    Repeated rows are separate pieces; a null doc_id is kept. An empty table gives an empty table.
    """
    spark = cut.sparkSession
    cut = materialise(cut, "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = sorted(plan(counts, capacity))
    buckets = max(16, math.isqrt(sum(counts.values())))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))
    table = np.array(runs, np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)  # lengths and rooms bound it, not the corpus
    kind = dict(cut.dtypes)["doc_id"]

    def place(batches):
        size, lo, _, first, per, offset = shared.value.T
        key = size << 48 | lo
        for batch in batches:
            n, r = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 5))
            run = np.searchsorted(key, n << 48 | r, side="right") - 1
            k = r - lo[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first[run] + k // per[run]), pa.array(offset[run] + k % per[run] * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
