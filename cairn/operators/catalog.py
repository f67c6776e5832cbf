"""What a store holds: names, versions, the latest one, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import plural, size_label, time_label


def names(manifests: DataFrame) -> DataFrame:
    return manifests.select("name").distinct()


def file_count(manifests: DataFrame) -> DataFrame:
    return manifests.agg(F.countDistinct("name").alias("files"))


def next_versions(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, next_version for every name of wanted: one more than the highest, 1 for an unknown name."""
    top = manifests.groupBy("name").agg(F.max("version").alias("top"))
    return wanted.select("name").distinct().join(top, "name", "left").select("name", (F.coalesce("top", F.lit(0)) + 1).cast("bigint").alias("next_version"))


def version_counts(manifests: DataFrame) -> DataFrame:
    """name, versions (the highest number, gaps included), n_readable (rows there are)."""
    return manifests.groupBy("name").agg(F.max("version").alias("versions"), F.count("*").alias("n_readable"))


def latest(manifests: DataFrame) -> DataFrame:
    """The row of the highest version of each name. Only the columns that are asked for are read."""
    others = [c for c in manifests.columns if c not in ("name", "version")]
    return manifests.groupBy("name").agg(F.max("version").alias("version"), *[F.max_by(c, "version").alias(c) for c in others])


def resolved(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name, version; -1: the latest) with the manifest that it means; unknown ones are left out."""
    top = manifests.groupBy("name").agg(F.max("version").alias("top"))
    asked = wanted.select("name", F.col("version").alias("asked")).join(top, "name")
    asked = asked.select("name", "asked", F.when(F.col("asked") == -1, F.col("top")).otherwise(F.col("asked")).alias("version"))
    return asked.join(manifests, ["name", "version"])


def with_latest(manifests: DataFrame) -> DataFrame:
    """manifests and is_latest: whether the version is its name's highest."""
    top = manifests.groupBy("name").agg(F.max("version").alias("top_version"))
    return manifests.join(top, "name").withColumn("is_latest", F.col("version") == F.col("top_version")).drop("top_version")


def history(manifests: DataFrame, name: str | None = None, gigabytes: bool = False) -> DataFrame:
    """Versions with labels; of one name in order, or of all names."""
    if name == "":
        raise ValueError("a name has one character at least")
    rows = manifests if name is None else manifests.filter(F.col("name") == name)
    out = with_latest(rows).select(
        "name", "version", "file_size", "num_chunks", "timestamp",
        size_label(F.col("file_size"), gigabytes).alias("size_label"),
        F.concat(F.col("num_chunks").cast("string"), F.lit(" "), plural(F.col("num_chunks"), "chunk")).alias("chunk_label"),
        time_label(F.col("timestamp")).alias("time_label"), "is_latest",
    )
    return out if name is None else out.orderBy("version")


def version_list(manifests: DataFrame, most: int) -> DataFrame:
    """The first `most` versions of each name, ascending. Rows beyond are dropped before the shuffle (a group limit)."""
    if most < 1:
        raise ValueError("one version at least")
    turn = F.row_number().over(Window.partitionBy("name").orderBy("version"))
    return manifests.withColumn("turn", turn).filter(F.col("turn") <= most).drop("turn")


def listing(manifests: DataFrame, gigabytes: bool = False) -> DataFrame:
    """One row for each name: its versions, the latest one's size and label."""
    top = manifests.groupBy("name").agg(F.max("version").alias("versions"), F.max_by("file_size", "version").alias("latest_size"))
    label = F.concat(F.col("versions").cast("string"), F.lit(" "), plural(F.col("versions"), "version"))
    return top.select("name", "versions", label.alias("version_label"), "latest_size", size_label(F.col("latest_size"), gigabytes).alias("size_label"))


def capped(listed: DataFrame, most: int) -> DataFrame:
    """The first `most` rows by name."""
    if most < 1:
        raise ValueError("one name at least")
    return listed.orderBy("name").limit(most)
