"""The driver's tables as files, versions and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.chunking import distinct_chunks, manifests_of, slices
from cairn.operators.lifecycle import Store

CHUNK = 1024
#: Consecutive ids that are numbered together.
SLOT = 1 << 16
STAMP = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payload(column: str):
    return F.encode(F.col(column), "UTF-8")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document, version 1."""
    name = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(name.alias("name"), F.lit(1).cast("bigint").alias("version"), (F.lit(STAMP) + F.col("doc_id")).alias("timestamp"), payload("text").alias("data"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each conversation, one version for each turn."""
    version = (F.col("turn") + 1).cast("bigint")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("name"), version.alias("version"), (F.lit(STAMP) + F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp"), payload("text").alias("data"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests without chunks: one file for each source, one version for each document of it."""
    size = F.octet_length(payload("text")).cast("bigint")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), "doc_id", (F.lit(STAMP) + F.col("doc_id")).alias("timestamp"), size.alias("file_size"))
    return sized(numbered(rows, "name", "doc_id"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each page, version 1."""
    return table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.lit(1).cast("bigint").alias("version"), (F.lit(STAMP) + F.col("page_id")).alias("timestamp"), payload("html").alias("data"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests without chunks: one file for each user, one version for each event."""
    when = F.unix_timestamp(F.col("ts").cast("timestamp"))
    size = F.octet_length(payload("props")).cast("bigint")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), "event_id", size.alias("file_size"), when.alias("timestamp"))
    return sized(numbered(rows, "name", "event_id"))


def sized(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Manifests without chunk lists: what catalogs need, without cutting payloads. files has data, or file_size in its place."""
    size = F.col("file_size") if "file_size" in files.columns else F.octet_length("data").cast("bigint")
    return files.select("name", "version", F.greatest(F.ceil(size / chunk), F.lit(1)).cast("bigint").alias("num_chunks"), size.alias("file_size"), "timestamp")


def numbered(rows: DataFrame, by: str, order: str, slot: int = SLOT) -> DataFrame:
    """rows with version: their place among those of one `by`, by `order` (integers that are unique within it).

    A key may hold any share of the rows: it is numbered in slots of `order`, and slots are placed by their counts.
    """
    rows = rows.withColumn("slot", F.floor(F.col(order) / slot))
    counts = rows.groupBy(by, "slot").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(by).alias("key"), F.col("slot").alias("at"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(by, "slot").orderBy(order)))
    rows = rows.join(counts, F.col(by).eqNullSafe(F.col("key")) & F.col("slot").eqNullSafe(F.col("at")))
    return rows.withColumn("version", (F.col("turn") + F.col("earlier")).cast("bigint")).drop("key", "at", "slot", "turn", "earlier")


def store(files: DataFrame, chunk: int = CHUNK) -> Store:
    cut = slices(files, chunk)
    return Store(manifests_of(cut), distinct_chunks(cut))


def two_nodes(spark: SparkSession, sf_dir: str) -> tuple[Store, Store]:
    """Node A has all manifests but the chunks of even documents alone; node B has everything."""
    cut = slices(documents(spark, sf_dir), CHUNK)
    manifests = manifests_of(cut)
    even = cut.filter(F.col("name").cast("bigint") % 2 == 0)
    return Store(manifests, distinct_chunks(even)), Store(manifests, distinct_chunks(cut))
