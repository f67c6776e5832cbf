"""New versions: upload, restore, and what a receiver checks before it takes a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import base_name, digest, has_digest_length
from cairn.operators.catalog import next_versions
from cairn.operators.chunking import manifest_chunks, new_chunks, slices
from cairn.schema import CHUNK_SIZE, MOST_CHUNKS


@dataclass(frozen=True)
class Store:
    """A node: its manifests and its chunks."""

    manifests: DataFrame
    chunks: DataFrame


@dataclass(frozen=True)
class Upload:
    """What an upload adds to a store, and the slices it came from."""

    manifests: DataFrame
    chunks: DataFrame
    cut: DataFrame


def upload(store: Store, files: DataFrame, size: int = CHUNK_SIZE, most_chunks: int = MOST_CHUNKS) -> Upload:
    """New versions of files (name or path, timestamp, data). Every row is a version, whatever its content.

    Names are last parts of paths; rows of one name are numbered by timestamp, then path, then digest; equal rows are
    versions of their own. Rows without a name or payload, and payloads of more than most_chunks chunks, are left out
    (upload_status tells why). Only what identifies rows is sorted, counted or joined, no payload: payloads are cut where they are read,
    and only distinct chunks move.
    """
    named = files.select(base_name(F.col("name")).alias("name"), F.col("name").alias("path"), "timestamp", "data")
    named = named.filter(F.col("name").isNotNull() & (F.octet_length("data") <= size * most_chunks)).withColumn("whole", digest(F.col("data")))
    alike = ["name", "path", "timestamp", "whole"]
    kinds = named.groupBy(*alike).agg(F.count("*").alias("copies"))
    before = F.sum("copies").over(Window.partitionBy("name").orderBy("timestamp", "path", "whole").rowsBetween(Window.unboundedPreceding, -1))
    kinds = kinds.withColumn("before", F.coalesce(before, F.lit(0))).join(next_versions(store.manifests, named), "name")
    kinds = kinds.select(*[F.col(c).alias(f"k_{c}") for c in alike], (F.col("next_version") + F.col("before")).alias("version"), "copies")
    cut = slices(named, size)
    lists = cut.groupBy(*alike).agg(F.array_sort(F.collect_set(F.struct("idx", "hash", "n"))).alias("all"))
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in alike]
    lists = lists.join(kinds, same[0] & same[1] & same[2] & same[3])
    lists = lists.select("name", F.explode(F.sequence("version", F.col("version") + F.col("copies") - 1)).alias("version"), "timestamp", "all")
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["n"])
    made = lists.select("name", "version", F.size("all").cast("bigint").alias("num_chunks"), total.alias("file_size"), "timestamp", F.transform("all", lambda x: x["hash"]).alias("chunk_hashes"))
    return Upload(made, new_chunks(cut, store.chunks), cut.drop("path", "whole"))


def upload_status(files: DataFrame, size: int = CHUNK_SIZE, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """name, status of each row: ok, or the first check that fails."""
    status = (
        F.when(F.col("data").isNull(), "no such file")
        .when(F.coalesce(F.regexp_extract("name", r"([^/]+)/*$", 1), F.lit("")) == "", "invalid name")
        .when(base_name(F.col("name")).isNull(), "name too long")
        .when(F.octet_length("data") > size * most_chunks, "too many chunks")
        .otherwise("ok")
    )
    return files.select("name", status.alias("status"))


def added(store: Store, new: Upload) -> Store:
    return Store(store.manifests.unionByName(new.manifests), store.chunks.unionByName(new.chunks.select(*store.chunks.columns)))


def missing_of(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, version, idx, hash of what manifests list and chunks lack; a null or empty hash is never there."""
    return manifest_chunks(manifests).join(chunks.select("hash").filter(F.col("hash") != ""), "hash", "left_anti").select("name", "version", "idx", "hash")


def restore_status(store: Store, wanted: DataFrame) -> DataFrame:
    """name, version, status, new_version of each request, checks in order: valid, known, whole, not the latest already."""
    asked = wanted.select("name", "version").distinct()
    top = store.manifests.groupBy("name").agg(F.max("version").alias("top"))
    known = store.manifests.select("name", "version", "chunk_hashes").join(asked, ["name", "version"], "left_semi")
    lacking = missing_of(known, store.chunks).select("name", "version").distinct().withColumn("lacks", F.lit(True))
    rows = asked.join(top, "name", "left").join(known.select("name", "version").withColumn("known", F.lit(True)), ["name", "version"], "left").join(lacking, ["name", "version"], "left")
    status = (
        F.when(F.col("name").isNull() | F.coalesce(F.col("version") < 1, F.lit(True)), "invalid")
        .when(F.col("known").isNull(), "not found")
        .when(F.col("lacks"), "missing chunks")
        .when(F.col("version") == F.col("top"), "already latest")
        .otherwise("ok")
    )
    return rows.select("name", "version", status.alias("status"), F.when(status == "ok", F.col("top") + 1).alias("new_version"))


def restore(store: Store, wanted: DataFrame, timestamp: Column | int) -> DataFrame:
    """The new manifests of requests (name, version; one for a name) that pass: old lists under the next version; no bytes are copied."""
    ok = restore_status(store, wanted).filter(F.col("status") == "ok").select("name", "version", "new_version")
    when = F.lit(timestamp) if isinstance(timestamp, int) else timestamp
    return store.manifests.join(ok, ["name", "version"]).select("name", F.col("new_version").alias("version"), "num_chunks", "file_size", when.cast("bigint").alias("timestamp"), "chunk_hashes")


def folded(offered: DataFrame) -> DataFrame:
    """offered with its digests in lower case, as chunks are named."""
    return offered.withColumn("chunk_hashes", F.transform("chunk_hashes", lambda h: F.lower(h)))


def commit_status(store: Store, offered: DataFrame, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """name, status, new_version of manifests that are offered (name, num_chunks, file_size, timestamp, chunk_hashes; one for a name). The receiver gives the version; digests count whatever their case."""
    offered = folded(offered)
    lists = offered.select("name", F.lit(0).cast("bigint").alias("version"), "chunk_hashes")
    lacking = missing_of(lists, store.chunks).select("name").distinct().withColumn("lacks", F.lit(True))
    bad = ~F.forall("chunk_hashes", has_digest_length)
    rows = offered.join(lacking, "name", "left").join(next_versions(store.manifests, offered), "name", "left")
    status = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", "missing arguments")
        .when(F.col("file_size").isNull() | F.col("num_chunks").isNull(), "invalid format")
        .when((F.col("num_chunks") < 0) | (F.col("num_chunks") > most_chunks), "invalid chunk count")
        .when(F.coalesce((F.size("chunk_hashes") != F.col("num_chunks")) | bad, F.lit(True)), "failed reading chunk list")
        .when(F.col("lacks"), "missing chunks")
        .otherwise("ok")
    )
    return rows.select("name", status.alias("status"), F.when(status == "ok", F.col("next_version")).alias("new_version"))


def committed(store: Store, offered: DataFrame, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """The manifests that are taken."""
    ok = commit_status(store, offered, most_chunks).filter(F.col("status") == "ok").select("name", F.col("new_version").alias("version"))
    return folded(offered).drop("version").join(ok, "name").select("name", "version", "num_chunks", "file_size", "timestamp", "chunk_hashes")
