"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a document and its tokens, a
delete takes both back, a revision adds the difference. A batch's deltas are summed before they are written, one small
table for each batch id, and its success marker is the commit: committing an id again changes nothing, and a batch that
was lost half-way is written anew. Totals add the last snapshot and the batches after it; compact() folds those into a
new snapshot, which remembers their ids so that sending one again still changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokenizer versions that SQL can count: a pattern whose matches are the tokens.
TOKENIZERS = {"space-1": r"[^\x20\x09-\x0D]+", "sign-1": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def tokens(text, tokenizer: str) -> F.Column:
    """Number of tokens; none for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def inserts(counted: DataFrame) -> DataFrame:
    """Deltas that add counted(source, lang, tokenizer, tokens), a row for each document and tokenizer."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Deltas that take such rows back."""
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("tokens")).alias("n_tokens"))


def revisions(changed: DataFrame) -> DataFrame:
    """Deltas of changed(source, lang, tokenizer, tokens, revised): the count went from tokens to revised."""
    return changed.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("revised") - F.col("tokens")).alias("n_tokens"))


class TokenRollup:
    """Rollup tables in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch_id):
            raise ValueError(f"a batch id has letters, digits, dots and hyphens: {batch_id!r}")
        return f"{self.folder}/batch={batch_id}"

    def _names(self, kind: str) -> list[str]:
        p, fs = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}="))

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _snapshot(self) -> str | None:
        """The folder of the last whole snapshot: its ids are written after its totals."""
        whole = [n for n in self._names("snapshot") if self._exists(f"{self.folder}/snapshot={n}/ids/_SUCCESS")]
        return f"{self.folder}/snapshot={whole[-1]}" if whole else None

    def committed(self, batch_id: str) -> bool:
        if self._exists(f"{self._path(batch_id)}/_SUCCESS"):
            return True
        last = self._snapshot()
        return last is not None and not self.spark.read.parquet(f"{last}/ids").where(F.col("batch") == batch_id).isEmpty()

    def commit(self, batch_id: str, *deltas: DataFrame) -> bool:
        """Add signed deltas once; False if the batch was there. Null sources and languages are groups of their own."""
        if self.committed(batch_id):
            return False
        rows = deltas[0]
        for d in deltas[1:]:
            rows = rows.unionByName(d)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(self._path(batch_id))
        return True

    def _open(self) -> list[str]:
        """Committed batches that the last snapshot lacks."""
        written = [b for b in self._names("batch") if self._exists(f"{self._path(b)}/_SUCCESS")]
        last = self._snapshot()
        if last is None or not written:
            return written
        asked = self.spark.createDataFrame([(b,) for b in written], "batch string")
        return sorted(r.batch for r in asked.join(self.spark.read.parquet(f"{last}/ids"), "batch", "left_anti").collect())

    def totals(self) -> DataFrame:
        """Current totals: every group that was ever seen, groups that came down to zero included."""
        last = self._snapshot()
        paths = [self._path(b) for b in self._open()] + ([f"{last}/totals"] if last else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> int:
        """Fold all open batches into a new snapshot and delete what it replaces; returns how many. A run that is cut short changes no total."""
        done, last = self._open(), self._snapshot()
        if done:
            number = int(last.rsplit("=", 1)[1]) + 1 if last else 1
            new = f"{self.folder}/snapshot={number:012d}"
            self.totals().coalesce(1).write.mode("overwrite").parquet(f"{new}/totals")
            ids = self.spark.createDataFrame([(b,) for b in done], "batch string")
            if last:
                ids = ids.unionByName(self.spark.read.parquet(f"{last}/ids"))
            ids.coalesce(1).write.mode("overwrite").parquet(f"{new}/ids")
            for path in [self._path(b) for b in done] + ([last] if last else []):
                p, fs = self._fs(path)
                fs.delete(p, True)
        return len(done)


def count_documents(docs: DataFrame, tokenizers: tuple[str, ...] = tuple(TOKENIZERS)) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, revised) of docs(doc_id, text, source, lang): revised counts each distinct line once.

    A null text has no tokens; repeated rows count each; other columns are ignored.
    """
    lines = F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1))

    def both(t: str):
        revised = F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + tokens(x, t))
        return F.struct(F.lit(t).alias("tokenizer"), tokens("text", t).alias("tokens"), revised.alias("revised"))

    each = [both(t) for t in tokenizers]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*each)).alias("c")).select("doc_id", "source", "lang", "c.*")
