"""Registered queries work on all rows of their tables."""

import hashlib

import duckdb
import pytest

from cairn.plans import queries

DATA = "/root/testdata/sf0.001"


def test_remote_upload_sends_every_document(spark):
    """Against the manifests of all documents, whatever the query's own SQL leaves out."""
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    sql = queries.cut_sql(queries.DOCUMENTS) + "select name, version + 1, num_chunks, file_size, ts, sha256(list) from m"
    got = [tuple(r) for r in queries.remote_upload(spark, DATA).collect()]
    assert sorted(got) == sorted(duck.execute(sql).fetchall())


#: Pages of one name: of two chunks, of three with one in common, of one, and another name's.
SAME_NAME = [(7, "http://a/?x=1", "a" * 1024 + "b"), (3, "http://a/?x=1", "a" * 1024 + "c" * 1024 + "d"), (5, "http://a/?x=1", "e"), (4, "http://b/", "f" * 1030)]


@pytest.fixture
def same_name(spark, tmp_path):
    spark.createDataFrame(SAME_NAME, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_meta_export_lists_all_chunks_of_a_name(spark, same_name):
    """As its SQL does; by page_id where the SQL leaves the order open."""
    want = []
    for page, url, html in SAME_NAME:
        chunks = sorted((i // 1024, p, sha(h[i : i + 1024])) for p, u, h in SAME_NAME if u == url for i in range(0, len(h), 1024))
        head = [f"name={url}", "version=1", f"chunks={-(-len(html) // 1024)}", f"size={len(html)}", f"timestamp={queries.STAMP + page}"]
        want.append((url, 1, sha("\n".join([*head, *[f"hash.{i}={h}" for i, _, h in chunks]]) + "\n")))
    assert sorted(map(tuple, queries.meta_export(spark, same_name).collect())) == sorted(want)


def test_meta_import_keeps_manifests_of_one_name_apart(spark, same_name):
    want = []
    for page, url, html in SAME_NAME:
        chunks = [sha(html[i : i + 1024]) for i in range(0, len(html), 1024)]
        want.append((url, 1, len(chunks), len(html), queries.STAMP + page, sha(",".join(chunks))))
    assert sorted(map(tuple, queries.meta_import(spark, same_name).collect())) == sorted(want)


def test_reassemble_keeps_pages_of_one_name_apart(spark, same_name):
    want = [(url, 1, len(html), sha(html)) for _, url, html in SAME_NAME]
    assert sorted(map(tuple, queries.reassemble(spark, same_name).collect())) == sorted(want)
