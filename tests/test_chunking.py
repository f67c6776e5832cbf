import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators.chunking import distinct_chunks, ingest_flags, manifest_chunks, manifests_of, new_chunks, reassembled, slices
from cairn.schema import SOURCE_FILES

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
HELLO = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def files(spark, *payloads, names=None):
    rows = [(names[i] if names else f"f{i}", 1, None if p is None else bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SOURCE_FILES).withColumn("version", F.lit(1).cast("bigint"))


def test_known_digests(spark):
    rows = slices(files(spark, b"", b"hello")).orderBy("name").collect()
    assert [(r["idx"], r["n"], r["hash"]) for r in rows] == [(0, 0, EMPTY), (0, 5, HELLO)]


def test_null_payload_has_no_slices_and_bad_size_is_refused(spark):
    assert slices(files(spark, None)).count() == 0
    with pytest.raises(ValueError):
        slices(files(spark, b"x"), 0)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_boundaries(spark, size):
    lengths = [0, 1, size - 1, size, size + 1, 3 * size + 17]
    data = [random.Random(n).randbytes(n) for n in lengths]
    got = {}
    for r in slices(files(spark, *data), size).orderBy("name", "idx").collect():
        got.setdefault(r["name"], []).append(bytes(r["data"]))
    for i, d in enumerate(data):
        assert got[f"f{i}"] == ([d[k : k + size] for k in range(0, len(d), size)] or [b""])


def test_default_size_cuts_at_4_mib(spark):
    data = bytes(4 * 1024 * 1024 + 1)
    assert [r["n"] for r in slices(files(spark, data)).orderBy("idx").collect()] == [4 * 1024 * 1024, 1]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=5), st.integers(1, 50))
def test_reassembled_is_what_was_cut(spark, data, size):
    cut = slices(files(spark, *data), size)
    whole = reassembled(manifest_chunks(manifests_of(cut)), distinct_chunks(cut)).collect()
    assert {r["name"]: bytes(r["data"]) for r in whole} == {f"f{i}": d for i, d in enumerate(data)}


def test_each_chunk_is_kept_once_and_flags_say_which_is_first(spark):
    cut = slices(files(spark, b"aabbaa", b"bbcc"), 2)
    assert sorted(bytes(r["data"]) for r in distinct_chunks(cut).collect()) == [b"aa", b"bb", b"cc"]
    flags = {(r["name"], r["idx"]): r["is_new"] for r in ingest_flags(cut, ["name", "idx"]).collect()}
    assert flags == {("f0", 0): True, ("f0", 1): True, ("f0", 2): False, ("f1", 0): False, ("f1", 1): True}
    stored = distinct_chunks(slices(files(spark, b"bb"), 2))
    assert sorted(bytes(r["data"]) for r in new_chunks(cut, stored).collect()) == [b"aa", b"cc"]
    assert sum(r["is_new"] for r in ingest_flags(cut, ["name", "idx"], stored).collect()) == 2


def test_code_points_may_be_split(spark):
    text = "é€😀" * 5
    cut = slices(files(spark, text.encode()), 2)
    [row] = reassembled(manifest_chunks(manifests_of(cut)), distinct_chunks(cut)).collect()
    assert bytes(row["data"]).decode() == text


def test_a_list_with_a_chunk_gone_is_not_reassembled(spark):
    cut = slices(files(spark, b"abcd"), 2)
    chunks = distinct_chunks(cut).filter(F.col("hash") != hashlib.sha256(b"ab").hexdigest())
    assert reassembled(manifest_chunks(manifests_of(cut)), chunks).count() == 0
