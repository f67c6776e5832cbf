import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


@pytest.mark.parametrize(
    ("size", "label"),
    [(0, "0 B"), (1023, "1023 B"), (KB, "1.0 KB"), (1280, "1.2 KB"), (1792, "1.8 KB"), (MB - 1, "1024.0 KB"), (MB, "1.0 MB"), (GB, "1024.0 MB")],
)
def test_size_label_rounds_ties_to_even(spark, size, label):
    assert spark.range(1).select(scalars.size_label(F.lit(size).cast("bigint"))).head()[0] == label


def test_gigabytes_only_where_asked_for(spark):
    assert spark.range(1).select(scalars.size_label(F.lit(3 * GB), True)).head()[0] == "3.0 GB"


@pytest.mark.parametrize(
    ("path", "name"),
    [("a/b.txt", "b.txt"), ("b.txt", "b.txt"), ("a/b/", "b"), ("/", None), ("", None), ("x" * 255, "x" * 255), ("x" * 256, None), ("é" * 128, None), ("a b=c", "a b=c")],
)
def test_base_name(spark, path, name):
    assert spark.createDataFrame([(path,)], "p string").select(scalars.base_name(F.col("p"))).head()[0] == name


@pytest.mark.parametrize(("text", "number"), [("12", 12), (" -7x", -7), ("abc", 0), ("", 0), ("12abc", 12), ("99999999999999999999", 0), (None, 0)])
def test_leading_integer(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.leading_integer(F.col("t"))).head()[0] == number


@pytest.mark.parametrize(("file", "version"), [("v4.meta", 4), ("v4.meta.tmp", None), ("v4", None), ("xv4.meta", None), ("v.meta", None)])
def test_version_of_file_is_strict(spark, file, version):
    assert spark.createDataFrame([(file,)], "f string").select(scalars.version_of_file(F.col("f"))).head()[0] == version


def test_paths_keys_and_digests(spark):
    h = "ab" + "0" * 62
    row = spark.createDataFrame([(h, "a=b=c", "none")], "h string, line string, bad string").select(
        scalars.chunk_path(F.col("h")).alias("path"), scalars.key_of(F.col("line")).alias("k"), scalars.value_of(F.col("line")).alias("v"), scalars.key_of(F.col("bad")).alias("nk"),
        scalars.is_digest(F.col("h")).alias("ok"), scalars.is_digest(F.upper("h")).alias("upper"), scalars.same_digest(F.col("h"), F.upper("h")).alias("same"), scalars.plural(F.lit(1), "chunk").alias("one"), scalars.plural(F.lit(2), "chunk").alias("two"), scalars.time_label(F.lit(0)).alias("time"),
    ).head()
    assert row["path"] == f"data/chunks/ab/{h}" and (row["k"], row["v"], row["nk"]) == ("a", "b=c", None)
    assert row["ok"] and not row["upper"] and row["same"] and (row["one"], row["two"]) == ("chunk", "chunks") and row["time"] == "1970-01-01 00:00:00"
