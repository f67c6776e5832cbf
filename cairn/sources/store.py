"""A store kept as Parquet: chunks first, manifests last, one writer at a time."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.lifecycle import Store, Upload, missing_of
from cairn.schema import CHUNKS, MANIFESTS


class Conflict(RuntimeError):
    """Another writer holds the store, or has added one of the versions."""


class ParquetStore:
    """manifests/ and chunks/ under a path in any file system of Spark's. Chunks are laid out by prefix, so a point read opens one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self._fs.exists(self._at(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def load(self) -> Store:
        return Store(self._table("manifests", MANIFESTS), self._table("chunks", CHUNKS))

    def add_chunks(self, chunks: DataFrame, files_each: int = 1) -> None:
        """Appends chunks that are not there yet; rows of one prefix go to files_each files."""
        salt = F.pmod(F.xxhash64("hash"), F.lit(files_each))
        new = chunks.dropDuplicates(["hash"]).join(self.load().chunks.select("hash"), "hash", "left_anti")
        new.repartition(F.col("prefix"), salt).write.mode("append").partitionBy("prefix").parquet(f"{self.path}/chunks")

    def commit(self, new: Upload) -> Store:
        """Chunks, then manifests that list them, under a lock file that only one writer can create."""
        lock = self._at("_writer")
        try:
            self._fs.create(lock, False).close()
        except Py4JJavaError as error:
            raise Conflict(f"{self.path} has a writer") from error
        try:
            self.add_chunks(new.chunks.select("hash", "size", "data", "prefix"))
            now = self.load()
            manifests = new.manifests.select("name", "version", "num_chunks", "file_size", "timestamp", "chunk_hashes")
            staged = f"{self.path}/_staged"
            manifests.write.mode("overwrite").parquet(staged)  # fixed before it is checked: reading it again gives the same
            manifests = self.spark.read.schema(MANIFESTS).parquet(staged)
            if not manifests.join(now.manifests, ["name", "version"], "left_semi").isEmpty():
                raise Conflict("a version is there already")
            if not missing_of(manifests, now.chunks).isEmpty():
                raise Conflict("chunks are missing")
            manifests.write.mode("append").parquet(f"{self.path}/manifests")
            self._fs.delete(self._at("_staged"), True)
        finally:
            self._fs.delete(lock, False)
        return self.load()
