"""Getting payloads back, and proof that they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import digest
from cairn.operators.chunking import manifest_chunks, reassembled
from cairn.operators.lifecycle import Store


def report(store: Store, manifests: DataFrame | None = None, verify: str = "digest") -> DataFrame:
    """name, version, num_chunks, n_missing, first_missing, size_ok, digest_ok, status of each manifest.

    verify: "digest" reads the chunks' bytes and checks each once; "size" reads
    no bytes. A list with a null or empty hash, or of another length than num_chunks, is invalid.
    """
    if verify not in ("digest", "size"):
        raise ValueError("verify is digest or size")
    wanted = store.manifests if manifests is None else manifests
    good = digest(F.col("data")) == F.col("hash") if verify == "digest" else F.lit(True)
    known = store.chunks.filter(F.col("hash") != "").select("hash", "size", good.alias("good"))
    lists = manifest_chunks(wanted).join(known, "hash", "left")
    lacks = F.col("good").isNull()
    seen = lists.groupBy("name", "version").agg(
        F.sum(lacks.cast("bigint")).alias("n_missing"),
        F.min(F.when(lacks, F.col("idx"))).alias("first_missing"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.bool_and(F.coalesce("good", F.lit(False))).alias("digest_ok"),
        F.bool_or(F.coalesce(F.col("hash"), F.lit("")) == "").alias("blank"),
    )
    rows = wanted.select("name", "version", "num_chunks", "file_size", F.size("chunk_hashes").alias("listed")).join(seen, ["name", "version"], "left")
    missing = F.coalesce("n_missing", F.lit(0))
    size_ok = F.coalesce("bytes", F.lit(0)) == F.col("file_size")
    digest_ok = F.coalesce("digest_ok", F.lit(True))
    invalid = F.coalesce(F.col("blank"), F.lit(False)) | (F.col("listed") != F.col("num_chunks"))
    status = F.when(invalid, "invalid manifest").when(missing > 0, "missing chunks").when(~size_ok, "size mismatch").when(~digest_ok, "corrupt chunk").otherwise("ok")
    return rows.select("name", "version", "num_chunks", missing.cast("bigint").alias("n_missing"), "first_missing", size_ok.alias("size_ok"), digest_ok.alias("digest_ok"), status.alias("status"))


def download(store: Store, manifests: DataFrame | None = None, verify: str = "digest") -> DataFrame:
    """name, version, data of the manifests whose report is ok; nothing in part."""
    wanted = store.manifests if manifests is None else manifests
    ok = report(store, wanted, verify).filter(F.col("status") == "ok").select("name", "version")
    return reassembled(manifest_chunks(wanted.join(ok, ["name", "version"], "left_semi")), store.chunks)


def chunk(store: Store, hash_: str) -> DataFrame:
    """One chunk, whatever the case of its digest; its prefix prunes partitions, its hash row groups."""
    if len(hash_) != 64:
        raise ValueError("a digest has 64 characters")
    hash_ = hash_.lower()
    return store.chunks.filter((F.col("prefix") == hash_[:2]) & (F.col("hash") == hash_))


def chunks_of(store: Store, asked: DataFrame) -> DataFrame:
    """The chunks that asked (hash) names, each once; digests count whatever their case."""
    wanted = asked.select(F.lower("hash").alias("hash"), F.lower(F.substring("hash", 1, 2)).alias("prefix")).distinct()
    return store.chunks.join(wanted, ["prefix", "hash"], "left_semi")


def first_missing(store: Store) -> DataFrame:
    """name, version, first_missing of manifests that lack chunks."""
    from cairn.operators.lifecycle import missing_of

    return missing_of(store.manifests, store.chunks).groupBy("name", "version").agg(F.min("idx").alias("first_missing"))
