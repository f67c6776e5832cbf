import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.operators import catalog, lifecycle, retrieve, sync
from cairn.operators.lifecycle import Store
from cairn.plans.protocol import Session, parsed, run_script
from cairn.schema import CHUNKS, MANIFESTS, SOURCE_FILES
from cairn.sources import files, metatext
from cairn.sources.store import Conflict, ParquetStore


def source(spark, *rows):
    return spark.createDataFrame([(n, t, None if d is None else bytearray(d)) for n, t, d in rows], SOURCE_FILES)


def fixed(spark, store: Store) -> Store:
    return Store(spark.createDataFrame(store.manifests.collect(), MANIFESTS), spark.createDataFrame(store.chunks.select("hash", "size", "data", "prefix").collect(), CHUNKS))


@pytest.fixture(scope="module")
def empty(spark):
    return Store(spark.createDataFrame([], MANIFESTS), spark.createDataFrame([], CHUNKS))


@pytest.fixture(scope="module")
def three(spark, empty):
    """Three versions of a, one of b, chunks of four bytes."""
    store = empty
    for i, data in enumerate((b"first text", b"second, longer text", b"third")):
        rows = [("dir/a", 100 + i, data)] + [("b", 100, b"")] * (i == 0)
        store = fixed(spark, lifecycle.added(store, lifecycle.upload(store, source(spark, *rows), 4)))
    return store


def versions(store):
    return sorted((r["name"], r["version"], r["file_size"]) for r in store.manifests.collect())


def test_uploads_number_versions(three):
    assert versions(three) == [("a", 1, 10), ("a", 2, 19), ("a", 3, 5), ("b", 1, 0)]


def test_unchanged_content_is_a_version_too_and_adds_no_chunk(spark, three):
    new = lifecycle.upload(three, source(spark, ("a", 9, b"third")), 4)
    assert [r["version"] for r in new.manifests.collect()] == [4] and new.chunks.count() == 0


def test_upload_checks(spark):
    rows = source(spark, ("ok", 1, b"x"), ("gone", 1, None), ("/", 1, b"x"), ("n" * 256, 1, b"x"), ("big", 1, b"x" * 41))
    assert [r["status"] for r in lifecycle.upload_status(rows, 4, 10).collect()] == ["ok", "no such file", "invalid name", "name too long", "too many chunks"]


def test_catalog(spark, three):
    m = three.manifests
    assert {r["name"]: r["next_version"] for r in catalog.next_versions(m, spark.createDataFrame([("a",), ("new",)], "name string")).collect()} == {"a": 4, "new": 1}
    assert {(r["name"], r["versions"], r["n_readable"]) for r in catalog.version_counts(m.filter("name = 'b' or version <> 2")).collect()} == {("a", 3, 2), ("b", 1, 1)}
    assert [(r["version"], r["is_latest"]) for r in catalog.history(m, "a").collect()] == [(1, False), (2, False), (3, True)]
    assert catalog.history(m, "unknown").count() == 0
    assert sorted(r["version"] for r in catalog.version_list(m, 2).filter("name = 'a'").collect()) == [1, 2]
    assert {(r["name"], r["version_label"], r["size_label"]) for r in catalog.listing(m).collect()} == {("a", "3 versions", "5 B"), ("b", "1 version", "0 B")}
    asked = spark.createDataFrame([("a", -1), ("a", 2), ("a", 9999), ("none", -1)], "name string, version bigint")
    assert sorted((r["asked"], r["version"]) for r in catalog.resolved(m, asked).collect()) == [(-1, 3), (2, 2)]
    assert [r["name"] for r in catalog.capped(catalog.listing(m), 1).collect()] == ["a"]


def test_restore(spark, three):
    asked = spark.createDataFrame([("a", 1), ("b", 1), ("a", 0), ("none", 1), ("a", 3)], "name string, version bigint")
    status = {(r["name"], r["version"]): (r["status"], r["new_version"]) for r in lifecycle.restore_status(three, asked).collect()}
    assert status == {("a", 1): ("ok", 4), ("b", 1): ("already latest", None), ("a", 0): ("invalid", None), ("none", 1): ("not found", None), ("a", 3): ("already latest", None)}
    [new] = lifecycle.restore(three, asked.filter("name = 'a' and version = 1"), 777).collect()
    [old] = three.manifests.filter("name = 'a' and version = 1").collect()
    assert (new["version"], new["timestamp"]) == (4, 777) and new["chunk_hashes"] == old["chunk_hashes"] and new["file_size"] == old["file_size"]


def test_restore_of_a_version_with_a_chunk_gone(spark, three):
    lame = Store(three.manifests, three.chunks.filter(F.col("hash") != hashlib.sha256(b"firs").hexdigest()))
    asked = spark.createDataFrame([("a", 1)], "name string, version bigint")
    assert lifecycle.restore_status(lame, asked).head()["status"] == "missing chunks"


def test_download(three):
    got = {(r["name"], r["version"]): bytes(r["data"]) for r in retrieve.download(three).collect()}
    assert got == {("a", 1): b"first text", ("a", 2): b"second, longer text", ("a", 3): b"third", ("b", 1): b""}


def test_reports_tell_what_is_wrong(spark, three):
    gone, changed = hashlib.sha256(b"t te").hexdigest(), hashlib.sha256(b"thir").hexdigest()
    chunks = three.chunks.filter(F.col("hash") != gone).withColumn("data", F.when(F.col("hash") == changed, F.encode(F.lit("THIR"), "UTF-8")).otherwise(F.col("data")))
    bad = spark.createDataFrame([("hole", 1, 2, 4, 0, ["", hashlib.sha256(b"d").hexdigest()]), ("short", 1, 3, 4, 0, [hashlib.sha256(b"d").hexdigest()]), ("size", 1, 1, 9, 0, [hashlib.sha256(b"d").hexdigest()])], MANIFESTS)
    report = {(r["name"], r["version"]): r for r in retrieve.report(Store(three.manifests.unionByName(bad), chunks)).collect()}
    assert (report["a", 1]["status"], report["a", 1]["n_missing"], report["a", 1]["first_missing"]) == ("missing chunks", 1, 1)
    assert report["a", 2]["status"] == "ok" and report["a", 3]["status"] == "corrupt chunk"
    assert report["hole", 1]["status"] == report["short", 1]["status"] == "invalid manifest" and report["size", 1]["status"] == "size mismatch"
    assert retrieve.report(Store(three.manifests, chunks), verify="size").filter("name = 'a' and version = 3").head()["status"] == "ok"
    with pytest.raises(ValueError):
        retrieve.report(three, verify="none")


def test_commit(spark, three):
    h = hashlib.sha256(b"thir").hexdigest()
    offered = spark.createDataFrame([("a", 0, 1, 4, 5, [h]), ("lost", 0, 1, 4, 5, ["f" * 64]), ("many", 0, 5000, 4, 5, [h]), ("list", 0, 2, 4, 5, [h]), ("bad", 0, 1, 4, 5, ["f" * 63]), ("new", 0, 0, 0, 5, [])], MANIFESTS)
    status = {r["name"]: (r["status"], r["new_version"]) for r in lifecycle.commit_status(three, offered).collect()}
    assert status == {"a": ("ok", 4), "lost": ("missing chunks", None), "many": ("invalid chunk count", None), "list": ("failed reading chunk list", None), "bad": ("failed reading chunk list", None), "new": ("ok", 1)}
    assert sorted((r["name"], r["version"]) for r in lifecycle.committed(three, offered).collect()) == [("a", 4), ("new", 1)]


def test_two_stores(spark, three, empty):
    local, remote, counts = sync.remote_upload(empty, three, source(spark, ("c", 1, b"thirnew!thir")), 4)
    assert counts.head().asDict() == {"name": "c", "version": 1, "n_chunks": 3, "n_present": 2, "n_sent": 1}
    assert ("c", 1, 12) in versions(remote) and local.chunks.count() == 2
    found, cache = sync.remote_download(local, remote, remote.manifests.filter("name = 'c'"))
    assert bytes(found.head()["data"]) == b"thirnew!thir" and cache.chunks.count() == 2
    plan = {r["hash"]: r["source"] for r in sync.fetch_plan(remote.manifests.filter("name in ('a', 'c') and version in (1, 3)"), local.chunks, remote.chunks).collect()}
    assert plan[hashlib.sha256(b"thir").hexdigest()] == "local" and plan[hashlib.sha256(b"firs").hexdigest()] == "remote"
    assert sync.upload_plan(remote.chunks, three.chunks).count() == 1
    assert sorted(r["present"] for r in sync.has_chunk(spark.createDataFrame([("f" * 64,), (hashlib.sha256(b"thir").hexdigest(),)], "hash string"), three.chunks).collect()) == [False, True]


def test_remote_download_repairs_and_refuses(spark, three):
    spoilt = Store(three.manifests, three.chunks.withColumn("data", F.when(F.col("hash") == hashlib.sha256(b"thir").hexdigest(), F.encode(F.lit("????"), "UTF-8")).otherwise(F.col("data"))))
    wanted = three.manifests.filter("name = 'a' and version = 3")
    found, cache = sync.remote_download(spoilt, three, wanted)
    assert bytes(found.head()["data"]) == b"third"
    assert bytes(retrieve.chunk(cache, hashlib.sha256(b"thir").hexdigest().upper()).head()["data"]) == b"thir" and cache.chunks.count() == three.chunks.count()
    assert sync.remote_download(spoilt, spoilt, wanted)[0].isEmpty()
    assert sync.remote_download(three, three, wanted.withColumn("file_size", F.lit(99).cast("bigint")))[0].isEmpty()


def test_one_name_several_times_in_an_upload(spark, three):
    rows = source(spark, ("x/a", 5, b"newer"), ("y/a", 4, b"older"), ("x/a", 5, b"newer"), ("y/a", 5, b"other"), ("z", 1, b""))
    new = lifecycle.upload(three, rows, 4)
    store = fixed(spark, lifecycle.added(three, new))
    got = {(r["name"], r["version"]): bytes(r["data"]) for r in retrieve.download(store).collect()}
    assert [got["a", v] for v in (4, 5, 6, 7)] == [b"older", b"newer", b"newer", b"other"] and got["z", 1] == b"" and len(got) == 9


def test_arguments(three):
    for call in (lambda: retrieve.chunk(three, "abc"), lambda: catalog.history(three.manifests, ""), lambda: catalog.version_list(three.manifests, 0), lambda: catalog.capped(three.manifests, 0)):
        with pytest.raises(ValueError):
            call()


def test_odd_protocol_lines(spark, three):
    s = Session(spark, three, clock=lambda: 1)
    h = hashlib.sha256(b"thir").hexdigest()
    for number in ("--5", "²", "5-", "+-1"):
        assert s.execute(f"GET_META a {number}") == ["ERR Invalid GET_META arguments"]
        assert s.execute(f"UPLOAD_META a {number} 1", [h, "END"]) == ["ERR Invalid UPLOAD_META format"]
        assert s.execute(f"STORE_CHUNK {h} {number}", b"thir") == ["ERR Invalid STORE_CHUNK format"]
    assert s.execute("GET_META a -1")[0] == "OK 3 5 2 102" and s.execute("GET_META a 99999999999999999999") == ["ERR File or version not found"]
    assert s.execute("GET_META") == ["ERR Missing filename for GET_META"] and s.execute("UPLOAD_META") == ["ERR Missing arguments for UPLOAD_META"]
    assert s.execute("UPLOAD_META a 4 1", [h]) == ["ERR Failed reading chunk list"] and s.execute("UPLOAD_META a 4 2", [h, "END"]) == ["ERR Failed reading chunk list"]
    assert s.execute(f"HAS_CHUNK {h.upper()}") == ["OK 1"] and s.execute(f"GET_CHUNK {h.upper()}")[0] == "OK 4"
    assert s.execute("UPLOAD_META a 4 1", [h.upper(), "end"]) == ["OK 4"] and s.execute("UPLOAD_META a 4 1", [h, "END"]) == ["OK 5"]
    assert s.execute("help")[0].endswith("GET_META <file> [ver], UPLOAD_META <file> <size> <count>, HELP, QUIT")


def test_protocol(spark, three, empty):
    assert Session(spark, empty).execute("LIST") == ["OK 0 files", "END"]
    s = Session(spark, three, clock=lambda: 42)
    assert s.execute("ping hello there") == ["PONG hello there"] and s.execute("  ") == [] and s.execute("PING") == ["PONG"]
    assert s.execute("NONSENSE x") == ["ERR Unknown command: NONSENSE x"]
    assert s.execute("list") == ["OK 2 files", "a 3 5", "b 1 0", "END"]
    assert s.execute("HISTORY b") == ["OK 1 versions", "v1 0 1 100", "END"] and s.execute("HISTORY") == ["ERR Missing filename for HISTORY"] and s.execute("HISTORY z") == ["ERR No versions found for file"]
    h = hashlib.sha256(b"new").hexdigest()
    assert s.execute(f"HAS_CHUNK {h}") == ["OK 0"] and s.execute("HAS_CHUNK x") == ["ERR Invalid hash"]
    assert s.execute(f"STORE_CHUNK {h} 3", b"neW") == ["ERR Hash mismatch"]
    assert s.execute(f"STORE_CHUNK {h.upper()} 3", b"new") == ["OK"] and s.execute(f"HAS_CHUNK {h}") == ["OK 1"]
    assert s.execute(f"STORE_CHUNK {h} 4194305", b"") == ["ERR Chunk exceeds maximum size"] and s.execute("STORE_CHUNK") == ["ERR Missing arguments for STORE_CHUNK"]
    assert s.execute(f"GET_CHUNK {h}") == ["OK 3", b"new".hex()] and s.execute("GET_CHUNK " + "f" * 64) == ["ERR Chunk not found"]
    assert s.execute("UPLOAD_META n.txt 3 1", [h, "END"]) == ["OK 1"] and s.execute("UPLOAD_META n.txt 3 1", ["f" * 64, "END"]) == ["ERR Incomplete upload: missing chunks"]
    assert s.execute("UPLOAD_META n.txt 3 9999", []) == ["ERR Invalid chunk count"]
    assert s.execute("GET_META n.txt") == ["OK 1 3 1 42", h, "END"] and s.execute("GET_META n.txt 7") == ["ERR File or version not found"] and s.execute("GET_META n.txt x") == ["ERR Invalid GET_META arguments"]
    assert run_script(s, ["INFO", "QUIT", "PING"])[1:] == [["BYE"]]
    rows = parsed(spark.createDataFrame([(1, " get_meta a  2 "), (2, "   "), (3, "what")], "seq bigint, line string")).orderBy("seq").collect()
    assert [(r["verb"], r["argument"], r["known"]) for r in rows] == [("GET_META", "a  2", True), ("WHAT", "", False)]


def test_parquet_store(spark, tmp_path):
    node = ParquetStore(spark, str(tmp_path / "node"))
    store = node.commit(lifecycle.upload(node.load(), source(spark, ("a", 1, b"one two"), ("e", 1, b"")), 4))
    store = node.commit(lifecycle.upload(store, source(spark, ("a", 2, b"one three")), 4))
    assert versions(store) == [("a", 1, 7), ("a", 2, 9), ("e", 1, 0)]
    assert bytes(retrieve.chunk(store, hashlib.sha256(b"one ").hexdigest()).head()["data"]) == b"one "
    assert store.chunks.groupBy("hash").count().filter("count > 1").isEmpty()
    (tmp_path / "node" / "_writer").touch()
    with pytest.raises(Conflict):
        node.commit(lifecycle.upload(store, source(spark, ("a", 3, b"x")), 4))


def test_files_on_disk(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    content = {"empty": b"", "small": b"abc", "pattern": bytes(i % 256 for i in range(8192))}
    for n, d in content.items():
        (folder / n).write_bytes(d)
    cut = files.read_slices(spark, str(folder), 1000).cache()
    assert {r["name"]: r["count"] for r in cut.groupBy("name").count().collect()} == {"empty": 1, "small": 1, "pattern": 9}
    assert all(r["hash"] == hashlib.sha256(r["data"]).hexdigest() for r in cut.collect())
    files.write_payloads(cut.withColumn("version", F.lit(1)), str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {f"{n}.v1": d for n, d in content.items()}
    assert files.digest_of_file(str(folder / "pattern")) == hashlib.sha256(content["pattern"]).hexdigest()


def test_small_files_share_a_task_and_large_ones_are_cut(spark, tmp_path):
    content = {f"f{i}": bytes([i % 256]) * (i % 7 * 500) for i in range(300)}
    for n, d in content.items():
        (tmp_path / n).write_bytes(d)
    cut = files.read_slices(spark, str(tmp_path), 1000)
    assert cut.rdd.getNumPartitions() == 1
    found = files.file_digests(cut.groupBy("path", "name").agg(F.count("*").alias("slices")), "name", "slices").collect()
    assert {r["name"]: (r["n"], r["hash"], r["slices"]) for r in found} == {n: (len(d), hashlib.sha256(d).hexdigest(), max(1, -(-len(d) // 1000))) for n, d in content.items()}
    (tmp_path / "large").write_bytes(bytes(300_000))
    parts = files.Reader({"path": str(tmp_path), "chunkSize": "1000", "slicesPerTask": "200"}).partitions()
    assert 2 < len(parts) < 200 and [(a, b) for p in parts for path, _, a, b in p.runs if path.endswith("large")] == [(0, 200), (200, 300)]


def test_many_payloads_are_written_whole(spark, tmp_path):
    """More than a writer holds open at once."""
    content = {f"f{i}": bytes([i % 256]) * (i % 5 * 700) for i in range(3 * files.OPEN)}
    rows = [(n, 1, k, bytearray(d[k * 1000 : (k + 1) * 1000])) for n, d in content.items() for k in range(max(1, -(-len(d) // 1000)))]
    files.write_payloads(spark.createDataFrame(rows[::-1], "name string, version int, idx bigint, data binary"), str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{n}.v1": d for n, d in content.items()}


def test_meta_text(spark, three):
    text = metatext.lines_of(three.manifests)
    lines = text.select(F.concat_ws("/", "name", F.col("version").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    back = metatext.parsed(lines)
    assert sorted(map(str, back.drop("path").collect())) == sorted(map(str, three.manifests.collect()))
    odd = spark.createDataFrame([("p", i, v) for i, v in enumerate(["name=x=y", "junk", "version=3abc", "version=4", "chunks=2", "hash.1=q", "hash.9999=z", "other=1", "size=abc"])], "path string, pos int, value string")
    row = metatext.parsed(odd).head()
    assert (row["name"], row["version"], row["file_size"], row["timestamp"], row["chunk_hashes"]) == ("x=y", 4, 0, 0, ["", "q"])


def test_streaming_ingest(spark, tmp_path):
    from cairn.streaming.ingest import ingest

    arrivals = str(tmp_path / "arrivals")
    source(spark, ("a", 1, b"one two"), ("b", 1, b"one three")).write.parquet(arrivals)
    node = ParquetStore(spark, str(tmp_path / "node"))
    for _ in range(2):
        ingest(spark.readStream.schema(SOURCE_FILES).parquet(arrivals), node, str(tmp_path / "check"), 4).awaitTermination()
    assert versions(node.load()) == [("a", 1, 7), ("b", 1, 9)]
