"""Cutting payloads into chunks, keeping each chunk once, and putting payloads together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import digest, prefix_of
from cairn.schema import CHUNK_SIZE


def slices(files: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Every column of files but data, and idx, data, n, hash of each slice of at most size bytes, in order.

    A payload of no bytes is one slice of no bytes; a null payload has none. The
    slices of a payload are made in one go, so the payload is not copied for each.
    """
    if size < 1:
        raise ValueError("a chunk has one byte at least")
    last = F.greatest(F.ceil(F.octet_length("data") / F.lit(size)), F.lit(1)) - 1
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.struct(i.alias("idx"), F.expr("data").substr((i * size + 1).cast("int"), F.lit(size)).alias("data")))
    others = [c for c in files.columns if c != "data"]
    out = files.filter(F.col("data").isNotNull()).select(*others, F.explode(cut).alias("slice"))
    out = out.select(*others, "slice.idx", F.col("slice.data").alias("data"))
    return out.withColumn("n", F.octet_length("data").cast("bigint")).withColumn("hash", digest(F.col("data")))


def distinct_chunks(cut: DataFrame) -> DataFrame:
    """hash, size, data, prefix: each chunk of cut once."""
    return cut.select("hash", F.col("n").alias("size"), "data").dropDuplicates(["hash"]).withColumn("prefix", prefix_of(F.col("hash")))


def new_chunks(cut: DataFrame, stored: DataFrame) -> DataFrame:
    """The chunks of cut that are not stored yet. Only hashes of the stored ones are read."""
    return distinct_chunks(cut).join(stored.select("hash"), "hash", "left_anti")


def ingest_flags(cut: DataFrame, order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """cut without data, and is_new: whether storing in this order meets the chunk for the first time.

    First places are minima, gathered before rows are shuffled: a chunk that a
    third of all slices share costs no more than any other.
    """
    place = F.struct(*order)
    first = cut.groupBy("hash").agg(F.min(place).alias("first_place"))
    if stored is not None:
        first = first.join(stored.select("hash").withColumn("there", F.lit(True)), "hash", "left")
        first = first.withColumn("first_place", F.when(F.col("there").isNull(), F.col("first_place"))).drop("there")
    return cut.drop("data").join(first, "hash").withColumn("is_new", F.coalesce(place == F.col("first_place"), F.lit(False))).drop("first_place")


def manifests_of(cut: DataFrame) -> DataFrame:
    """One row for each payload of cut (name, version, timestamp): its chunks in order, their number and bytes."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
    return cut.groupBy("name", "version", "timestamp").agg(F.count("*").alias("num_chunks"), F.sum("n").alias("file_size"), ordered.alias("chunk_hashes")).select("name", "version", "num_chunks", "file_size", "timestamp", "chunk_hashes")


def manifest_chunks(manifests: DataFrame, *others: str) -> DataFrame:
    """name, version, others, idx, hash: the list of each manifest, unrolled; others are columns of manifests to keep."""
    return manifests.select("name", "version", *others, F.posexplode("chunk_hashes").alias("idx", "hash")).withColumn("idx", F.col("idx").cast("bigint"))


def reassembled(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, version, data: the chunks of each list, end to end, as bytes; only lists whose chunks are all there.

    More columns of lists (a timestamp, say) tell lists of one name and version apart, and stay. Each value is one payload and has to fit in a row; payloads beyond that are
    written slice by slice (sources.files.write_payloads).
    """
    by = [c for c in lists.columns if c not in ("idx", "hash")]
    found = lists.join(chunks.select("hash", "data", F.lit(True).alias("there")), "hash", "left")
    whole = found.groupBy(*by).agg(F.count("*").alias("wanted"), F.count("there").alias("found"), F.expr("listagg(data, X'') within group (order by idx)").alias("data"))
    return whole.filter(F.col("found") == F.col("wanted")).select(*by, "data")
