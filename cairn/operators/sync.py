"""Two stores: what one has, what the other needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import digest
from cairn.operators.chunking import manifest_chunks
from cairn.operators.lifecycle import Store, Upload, added, committed, upload
from cairn.operators.retrieve import download
from cairn.schema import CHUNK_SIZE


def has_chunk(hashes: DataFrame, chunks: DataFrame) -> DataFrame:
    """hash, present for each distinct hash."""
    there = chunks.select("hash").distinct().withColumn("there", F.lit(True))
    return hashes.select("hash").distinct().join(there, "hash", "left").select("hash", F.coalesce("there", F.lit(False)).alias("present"))


def upload_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """hash, size of the chunks that the remote store lacks. Hashes alone are compared."""
    return local.select("hash", "size").dropDuplicates(["hash"]).join(remote.select("hash"), "hash", "left_anti")


def fetch_plan(manifests: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """hash, source for each chunk that manifests list: local if it is there, else remote, else missing."""
    wanted = manifest_chunks(manifests).select("hash").distinct()
    near = local.select("hash").distinct().withColumn("near", F.lit(True))
    far = remote.select("hash").distinct().withColumn("far", F.lit(True))
    source = F.when(F.col("near"), "local").when(F.col("far"), "remote").otherwise("missing")
    return wanted.join(near, "hash", "left").join(far, "hash", "left").select("hash", source.alias("source"))


def dedup_counts(cut: DataFrame, stored: DataFrame) -> DataFrame:
    """name, version, n_chunks, n_present, n_sent: of each payload's slices, how many the receiver had."""
    there = stored.select("hash").distinct().withColumn("there", F.lit(True))
    had = F.col("there").isNotNull().cast("bigint")
    return cut.drop("data").join(there, "hash", "left").groupBy("name", "version").agg(F.count("*").alias("n_chunks"), F.sum(had).alias("n_present"), F.sum(1 - had).cast("bigint").alias("n_sent"))


def remote_upload(local: Store, remote: Store, files: DataFrame, size: int = CHUNK_SIZE) -> tuple[Store, Store, DataFrame]:
    """The stores afterwards, and the counts of what was sent: chunks first, then the manifest, which the receiver numbers. Chunks stay in the local cache too."""
    new: Upload = upload(remote, files, size)
    counts = dedup_counts(manifest_chunks(new.manifests), remote.chunks)
    with_chunks = Store(remote.manifests, added(remote, new).chunks)
    taken = committed(with_chunks, new.manifests)
    cache = new.cut.select("hash", F.col("n").alias("size"), "data").dropDuplicates(["hash"]).withColumn("prefix", F.substring("hash", 1, 2))
    cache = cache.join(local.chunks.select("hash"), "hash", "left_anti").select(*local.chunks.columns)
    return Store(local.manifests, local.chunks.unionByName(cache)), Store(remote.manifests.unionByName(taken), with_chunks.chunks), counts


def remote_download(local: Store, remote: Store, manifests: DataFrame) -> tuple[DataFrame, Store]:
    """name, version, data of remote manifests that come out whole, chunks from the local store first; and the local store with what was fetched.

    A chunk counts only if its bytes have its digest, on either side: a damaged local one is fetched again and
    replaced. A manifest whose chunks are not all there, or sum to another size, gives nothing.
    """
    wanted = manifest_chunks(manifests).select("hash").distinct()

    def sound(chunks: DataFrame) -> DataFrame:
        return chunks.join(wanted, "hash", "left_semi").filter(digest(F.col("data")) == F.col("hash")).select("hash", "size", "data", "prefix")

    near = sound(local.chunks)
    fetched = sound(remote.chunks.join(near.select("hash"), "hash", "left_anti"))
    kept = local.chunks.join(fetched.select("hash"), "hash", "left_anti")
    found = download(Store(manifests, near.unionByName(fetched)), verify="size")  # digests have been compared
    return found, Store(local.manifests, kept.select(*local.chunks.columns).unionByName(fetched.select(*local.chunks.columns)))
