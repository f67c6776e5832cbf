"""Files on disk as slices, without reading a whole file into a row, and back."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cairn.schema import CHUNK_SIZE

SLICES = "path string, name string, idx bigint, n bigint, hash string, data binary, timestamp bigint"
COLUMNS = pa.schema([("path", pa.string()), ("name", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("hash", pa.string()), ("data", pa.binary()), ("timestamp", pa.int64())])
#: Bytes of a task, what opening a file counts as, and bytes that are passed on at once.
TASK, OPENING, BATCH = 64 << 20, 64 << 10, 4 << 20
#: Files that a writer holds open, and about as many bytes, before all are made safe together.
OPEN, UNSAFE = 128, 64 << 20


@dataclass
class Part(InputPartition):
    """Consecutive slices of files: path, timestamp, first and last (exclusive) of each."""

    runs: list[tuple[str, int, int, int]]


class FileSlices(DataSource):
    """format("cairn_files"): options path (a file or a folder of files that all executors see), chunkSize, slicesPerTask.

    A task reads small files up to so many slices' bytes together, and so many slices of a large one. A file of no bytes is one slice of no bytes. Files are listed when the query is planned.
    """

    @classmethod
    def name(cls) -> str:
        return "cairn_files"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("chunkSize", CHUNK_SIZE))
        self.per_task = int(options.get("slicesPerTask", max(1, TASK // self.size)))

    def partitions(self) -> list[Part]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        paths = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names)
        out: list[Part] = []
        room = 0
        for p in paths:
            info = os.stat(p)
            last = max(1, -(-info.st_size // self.size))
            for i in range(0, last, self.per_task):
                end = min(i + self.per_task, last)
                cost = OPENING + min(end * self.size, info.st_size) - i * self.size
                if not out or cost > room:
                    out.append(Part([]))
                    room = self.per_task * self.size
                out[-1].runs.append((p, int(info.st_mtime), i, end))
                room -= cost
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, timestamp, first, last in partition.runs:
            with open(path, "rb") as f:
                f.seek(first * self.size)
                for i in range(first, last):
                    data = f.read(self.size)
                    rows.append((path, os.path.basename(path), i, len(data), hashlib.sha256(data).hexdigest(), data, timestamp))
                    held += len(data) + 256
                    if held >= BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), COLUMNS.types, strict=True)], schema=COLUMNS)


def read_slices(spark: SparkSession, path: str, size: int = CHUNK_SIZE) -> DataFrame:
    """The slices of the files at path."""
    spark.dataSource.register(FileSlices)
    return spark.read.format("cairn_files").option("chunkSize", str(size)).load(path)


def digest_of_file(path: str, buffer: int = 1 << 20) -> str:
    """SHA-256 of a file of any size."""
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(buffer):
            out.update(block)
    return out.hexdigest()


def tasks(found: DataFrame) -> int:
    """Into how many tasks files are dealt: rows are small beside the work on their files, so adaptive execution would put them into a few."""
    spark = found.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_digests(found: DataFrame, *others: str) -> DataFrame:
    """path, others, n, hash of the files that found (path) names, each read where its task runs, buffer by buffer; others are columns of found to keep."""
    rows = found.select("path", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            more = [pa.array([os.path.getsize(p) for p in paths], pa.int64()), pa.array([digest_of_file(p) for p in paths], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "n", "hash"])

    return rows.repartition(tasks(found), "path").mapInArrow(run, StructType([*rows.schema.fields, StructField("n", LongType()), StructField("hash", StringType())]))


def write_payloads(found: DataFrame, folder: str) -> None:
    """Writes slices (name, version, idx, data) as folder/name.vN, slice by slice: a temporary file, then a rename. folder is one that all executors see.

    Files are renamed once their bytes are on disk, some at a time: after one sync of all, an fsync has little left to do and tells of errors.
    """

    def write(rows) -> None:
        now, written, opened = None, 0, []

        def settle() -> None:
            for f, _ in opened:
                f.flush()
            os.sync()
            for f, _ in opened:
                os.fsync(f.fileno())
                f.close()
            for f, path in opened:
                os.replace(f.name, path)
            opened.clear()

        for r in rows:
            if (r["name"], r["version"]) != now:
                if len(opened) >= OPEN or written >= UNSAFE:
                    settle()
                    written = 0
                now = r["name"], r["version"]
                f = open(os.path.join(folder, f".{now[0]}.v{now[1]}.tmp"), "wb")  # noqa: SIM115
                opened.append((f, os.path.join(folder, f"{now[0]}.v{now[1]}")))
            opened[-1][0].write(r["data"])
            written += len(r["data"])
        if opened:
            settle()

    os.makedirs(folder, exist_ok=True)
    found.select("name", "version", "idx", "data").repartition(tasks(found), "name", "version").sortWithinPartitions("name", "version", "idx").foreachPartition(write)
