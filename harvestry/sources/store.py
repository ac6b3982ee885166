"""A folder of tables in versions, written whole or not at all: `format("versioned")`.

Tasks write Parquet files that nobody reads yet; the commit then writes the version's manifest, last and in one step, and
only manifests say which files count. A write that is killed or aborted leaves the version before it in place. A write
with a batch name that is already in the store changes nothing, so a job that is run again does no harm.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "versioned"


class Manifests:
    """The versions of a store in any file system that Arrow reaches."""

    def __init__(self, path: str):
        self.path = path
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def versions(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/versions", allow_not_found=True))
        return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))

    def read(self, version: int | None = None) -> dict:
        """A version's manifest, the last one's by default; an empty one before the first."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "files": [], "batches": []}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        with self.files.open_input_stream(f"{self.root}/versions/{version}.json") as f:
            return json.loads(f.read())

    def write(self, manifest: dict) -> None:
        self.files.create_dir(f"{self.root}/versions")
        at = f"{self.root}/versions/{manifest['version']}.json"
        if self.files.get_file_info(at).type != fs.FileType.NotFound:
            raise RuntimeError(f"another writer made version {manifest['version']} of {self.path}")
        staged = f"{self.root}/versions/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(staged) as f:
            f.write(json.dumps(manifest).encode())
        self.files.move(staged, at)

    def vacuum(self) -> int:
        """Delete the files that no version names, which writes that were killed leave behind; not while another write runs."""
        named = {name for v in self.versions() for name in self.read(v)["files"]}
        found = [f"data/{x.base_name}" for x in self.files.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True))]
        stray = [name for name in found if name not in named]
        self.delete(stray)
        return len(stray)

    def delete(self, names: list[str]) -> None:
        for name in names:
            if self.files.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound:
                self.files.delete_file(f"{self.root}/{name}")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, batch: str | None):
        self.path, self.schema, self.overwrite, self.batch = path, schema.json(), overwrite, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, name, rows, out = Manifests(self.path), f"data/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    store.files.create_dir(f"{store.root}/data")
                    out = pq.ParquetWriter(f"{store.root}/{name}", batch.schema, filesystem=store.files, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                store.delete([name])
            raise
        if out is not None:
            out.close()
        return Written([name] if out is not None else [], rows)

    def commit(self, messages: list[Written | None]) -> None:
        store = Manifests(self.path)
        last = store.read()
        files = [name for m in messages if m for name in m.files]
        if self.batch and self.batch in last["batches"]:
            store.delete(files)
            return
        if last["schema"] and last["schema"] != self.schema and not self.overwrite:
            store.delete(files)
            raise ValueError(f"{self.path} has other columns")
        kept = [] if self.overwrite else last["files"]
        store.write({"version": last["version"] + 1, "schema": self.schema, "files": [*kept, *files], "batches": [*last["batches"], *([self.batch] if self.batch else [])]})

    def abort(self, messages: list[Written | None]) -> None:
        Manifests(self.path).delete([name for m in messages if m for name in m.files])


@dataclass
class StoredFile(InputPartition):
    name: str


class StoreReader(DataSourceReader):
    def __init__(self, path: str, version: int | None):
        self.path, self.names = path, Manifests(path).read(version)["files"]

    def partitions(self) -> list[StoredFile]:
        return [StoredFile(name) for name in self.names]

    def read(self, partition: StoredFile) -> Iterator[pa.RecordBatch]:
        if getattr(partition, "name", None):
            store = Manifests(self.path)
            with store.files.open_input_file(f"{store.root}/{partition.name}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class VersionedStore(DataSource):
    """Options: path, a folder that all executors reach; batch, a write's name; version, the one to read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        version = self.options.get("version")
        known = Manifests(self.options["path"]).read(int(version) if version else None)["schema"]
        if known is None:
            raise ValueError(f"nothing is stored in {self.options['path']}")
        return StructType.fromJson(json.loads(known))

    def reader(self, schema: StructType) -> StoreReader:
        version = self.options.get("version")
        return StoreReader(self.options["path"], int(version) if version else None)

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], schema, overwrite, self.options.get("batch"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VersionedStore)


def merged(old: DataFrame, new: DataFrame, source: str, owner: str, order: str, n: str = "n") -> DataFrame:
    """Old rows whose source the new ones don't have, then the new ones, numbered anew from 1 by owner.

    Old rows keep their order and come first; a null source is replaced by nothing and replaces nothing.
    """
    kept = old.join(new.select(F.col(owner).alias("_owner"), F.col(source).alias("_source")).distinct(), (F.col(owner) == F.col("_owner")) & (F.col(source) == F.col("_source")), "left_anti")
    both = kept.withColumns({"_late": F.lit(0), "_at": F.col(n).cast("long")}).drop(n).unionByName(new.drop(n).withColumns({"_late": F.lit(1), "_at": F.col(order).cast("long")}))
    return both.withColumn(n, F.row_number().over(Window.partitionBy(owner).orderBy("_late", "_at", source))).drop("_late", "_at")
