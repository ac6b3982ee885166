"""Shared plumbing: the cluster's checkpoint folder, materialised tables and Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TEXT_CHUNK = 2 << 20  # bytes of text that a vectorised kernel holds at once
BATCH = "4m"  # bytes of a batch that a task's Python gets; by rows alone it follows the length of texts


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local one only where none is set and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/harvestry-checkpoints"
    return path.rstrip("/")


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Settings of the session for a while, then those before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, **more: str):
    """While it is open, what runs hands Python batches of at most BATCH bytes (and a row)."""
    return _settings(spark, **{"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}, **more)


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df once into the shared folder, with options for Parquet, and read it back, which cuts its lineage.

    The shuffle files behind it go when it is written; else they wait for the driver's next collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that Spark must not broadcast: it grows with the input, by far more than the size of its files tells, and would go through the driver."""
    return df.hint("merge")


def drop_table(df: DataFrame) -> None:
    """Remove a table that materialise() wrote, through Hadoop's file system interface."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {x.lower() for x in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = TEXT_CHUNK):
    """Slices (start row, rows, bytes, offsets) of one string column; a single long text may exceed the limit.

    Null texts count as empty. The bytes are a view of Arrow's buffer, offsets start at 0.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi - lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, letter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a chunk and, per text, the index of its first word (with one more at the end).

    With a table of letters, words also end where another byte follows a letter.
    """
    inside = ~sep[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if letter is not None:
        turn = letter[raw[:-1]] & ~letter[raw[1:]] & inside[1:]
        first[1:] |= turn
        last[:-1] |= turn
    cuts = off[:-1][off[:-1] < len(raw)]
    first[cuts] = inside[cuts]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


_POWERS: dict[int, np.ndarray] = {}
_POWERS_KEPT = 1 << 19  # a longer table is made for the call alone


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n; short ones are slices of a table that a task makes once."""
    if n <= _POWERS_KEPT and base in _POWERS:
        return _POWERS[base][:n]
    p = np.full(max(n, _POWERS_KEPT), base, dtype=np.uint64)
    p[:1] = 1
    np.cumprod(p, dtype=np.uint64, out=p)
    if n <= _POWERS_KEPT:
        _POWERS[base] = p
    return p[:n]


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of the words raw[start:end]: mixed polynomial hashes, the same wherever a word stands."""
    byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte[raw] * powers(_BASE, len(raw)), out=run[1:])
    word = (run[ends] - run[starts]) * powers(_BASE_INVERSE, len(raw))[starts]
    return mix64(word + (ends - starts).astype(np.uint64))
