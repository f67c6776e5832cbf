"""Scalar functions of the store, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.schema import LONGEST_NAME


def digest(data: Column) -> Column:
    """SHA-256 in lower-case hex; null of null."""
    return F.sha2(data, 256)


def hex_of(data: Column) -> Column:
    return F.lower(F.hex(data))


def prefix_of(digest: Column) -> Column:
    """The two characters by which chunks are sharded."""
    return F.substring(digest, 1, 2)


def chunk_dir(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("data/chunks"), prefix_of(digest))


def chunk_path(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("data/chunks"), prefix_of(digest), digest)


def meta_dir(name: Column) -> Column:
    return F.concat(F.lit("data/meta/"), name)


def meta_path(name: Column, version: Column) -> Column:
    return F.concat(F.lit("data/meta/"), name, F.lit("/v"), version.cast("string"), F.lit(".meta"))


def base_name(path: Column) -> Column:
    """The last part of a path; null where there is none or it is too long."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when((name != "") & (F.octet_length(name) <= LONGEST_NAME), name)


def version_of_file(name: Column) -> Column:
    """N of vN.meta, and of nothing else."""
    return F.regexp_extract(name, r"^v([0-9]+)\.meta$", 1).try_cast("bigint")


def size_label(size: Column, gigabytes: bool = False) -> Column:
    """Bytes for people: B below 1 KB, then KB, MB (and GB, if asked for), one decimal, ties to even."""

    def by(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size / F.lit(float(1 << power)), 1))

    out = F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, by(10, "KB"))
    return out.when(size < 1 << 30, by(20, "MB")).otherwise(by(30, "GB")) if gigabytes else out.otherwise(by(20, "MB"))


def time_label(seconds: Column) -> Column:
    """Unix seconds as year-month-day hours:minutes:seconds, in the session's zone."""
    return F.from_unixtime(seconds, "yyyy-MM-dd HH:mm:ss")


def plural(count: Column, word: str) -> Column:
    return F.when(count == 1, F.lit(word)).otherwise(F.lit(f"{word}s"))


def leading_integer(text: Column) -> Column:
    """The integer that text begins with, 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def key_of(line: Column) -> Column:
    """What comes before the first = of a line; null where there is none."""
    return F.when(line.contains("="), F.split(line, "=", 2)[0])


def value_of(line: Column) -> Column:
    return F.when(line.contains("="), F.split(line, "=", 2)[1])


def is_digest(text: Column) -> Column:
    """64 lower-case hex digits."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def has_digest_length(text: Column) -> Column:
    return F.coalesce(F.length(text) == 64, F.lit(False))


def same_digest(a: Column, b: Column) -> Column:
    """Digests are equal whatever their case."""
    return F.lower(a) == F.lower(b)
