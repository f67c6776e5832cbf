"""What the operators of this folder share: tables, durable cuts of the lineage, bounded memory."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import shared_folder

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir)."""
    path = shared_folder(spark, "cairn")
    _made.append(path)
    return path


def made() -> int:
    """How many folders durable() has written in this process."""
    return len(_made)


def sweep(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what durable() has written in this process since there were `since` folders, but the last `keep`; results that were built on it must have been written by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in _made[since : len(_made) - keep]:
        at = path(name)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(name)


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and losing an executor costs nothing."""
    path = durable_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not use yet (whatever their case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def identity(*of: Column | str) -> Column:
    """128 bits that tell values apart: two 64-bit hashes of different seeds, as bytes."""
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *of)), 16, "0") for seed in ("left", "right")]
    return F.unhex(F.concat(*halves))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, of any types; what settles the order of rows that are alike in what an operator looks at."""
    return F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))


def give_back() -> None:
    """Returns memory that this worker no longer uses to the system: workers live on after a task, several to an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Batches that go to Python are bounded by bytes; texts may be long, so by rows too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
