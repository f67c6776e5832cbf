"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import embeddings, html, licenses, minhash, mixing, packing, quality, suffix, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PROSE = "the quick brown fox jumps over the lazy dog and runs away from every single thing that it has ever seen in its life "
ROWS = [
    (1, PROSE * 3, "en", "a", 1),
    (1, PROSE * 3, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "a text without an id, of some words", "en", "b", 3),
    (None, None, None, None, None),
    (4, "  \n\t \n", "en", "b", 4),
    (5, "été 中文 😀 ﬁ ǅ " * 40, "fr", "c", 5),
    (6, "word " * 60_000, "en", "c", 6),
    (7, "x" * 100_000, "en", None, 7),
    (4, "another text with the same id", "en", "", 4),
    (8, "<|endoftext|> and <|startoftext|>\0 'S \x1c", "en", "d", 8),
]
CLASH = ("id", "size", "n", "label", "score", "block", "row", "rest", "data", "task", "rank", "copies", "near_id", "mix_size", "text_was_null", "plain", "bucket", "ROW", "DOC")
LABELS = [(i, i % 2, i % 3 % 2) for i in (1, 3, 5, 6, 7, 8)] + [(1, None, None), (None, 1, 1), (99, 1, 0), (1, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for i, c in enumerate(c for c in CLASH if c.islower()):
        made = made.withColumn(c, F.lit(i))
    return made.withColumn("attributes", F.create_map(F.lit("k"), F.lit(1))).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "tokens": lambda d, _: token_counts.token_counts(d, WORDS),
    "licences": lambda d, _: licenses.licences(d),
    "mix": lambda d, _: mixing.mix(d),
    "quality": lambda d, y: quality.quality(d, y),
    "toxicity": lambda d, y: toxicity.toxicity(d, y),
    "near": lambda d, _: minhash.near_duplicates(d),
    "repeats": lambda d, _: suffix.removals(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, name):
    out = OPERATORS[name](docs, labels)
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    nullable = {"doc_id", "class_id", "license_id", "quality"}
    assert all(r[c] is not None for r in rows for c in out.columns if c not in nullable)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []
    assert OPERATORS[name](docs.limit(0), labels).collect() == []


def test_no_labels(docs, labels):
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    rows = quality.quality(docs, labels.limit(0)).collect()
    assert {r["quality"] for r in rows} == {None} and all(r["kept"] != r["base_failed"] for r in rows)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, docs, labels, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if stage is not corpus_pipeline.packing:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert rows
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.collect() == []


def test_pieces_of_edge_texts(docs):
    rows = packing.pack(docs, BYTES).collect()
    whole = sorted(str(r["doc_id"]) for r in rows if r["start"] == 0)
    assert whole == sorted(str(r[0]) for r in ROWS)
    assert packing.pack(docs.limit(0), BYTES).collect() == []


def test_near_duplicates_keep_one_of_repeated_rows(docs):
    left = minhash.deduplicated(docs).collect()
    assert sum(r["text"] == PROSE * 3 for r in left) == 1
    assert sum(not (r["text"] or "").strip() for r in left) == 1


@pytest.mark.parametrize("stage", [minhash.deduplicated, mixing.mixed, suffix.cut_out])
def test_columns_of_the_operators_own_names(spark, stage):
    names = ["near:id", "near:doc", "near_row", "mix:base", "mix:more", "mix_n", "hot key", "found value", "id", "component", "more", "row", "turn", "string", "NEAR_ID"]
    rows = [(1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (None, None, None, None, None)]
    made = spark.createDataFrame(rows, SCHEMA)
    for n in names:
        made = made.withColumn(n, F.lit(n))
    out = stage(made)
    assert out.columns == made.columns and all(r[n] == n for r in out.collect() for n in names)


def test_of_rows_with_one_id_and_text_the_same_one_stays(spark):
    rows = [(1, PROSE, "en", s, 1) for s in "abcdefgh"] + [(2, "other words", "fr", s, 1) for s in "xyz"]
    kept = {tuple(sorted((r["doc_id"], r["source"]) for r in minhash.deduplicated(spark.createDataFrame(rows[k:] + rows[:k], SCHEMA).repartition(1 + k % 4)).collect())) for k in (0, 3, 7)}
    assert len(kept) == 1


def test_repeats_of_repeated_rows(docs):
    rows = [r for r in suffix.removals(docs).collect() if r["doc_id"] == 1]
    size = len(PROSE) * 3
    assert sorted(r["n_removed"] for r in rows) == [size - len(PROSE) - 99 if size - len(PROSE) < 99 else len(PROSE) * 2, size]


def test_pages(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<p>a", "t", 0), (1, "u", "<p>a", "t", 0), (None, None, None, None, None), (2, "", "", "", 0), (3, "u", "<div>" * 5000 + "deep", "", 0), (4, "u", "<p>" + "word " * 200_000, "", 0), (5, "u", "<<a <b>>&&#x110000;&nope;<!-- <table><td", "", 0)]
    out = html.extracted(spark.createDataFrame(rows, schema)).collect()
    assert [r["text"] for r in out][:4] == ["a", "a", "", ""] and out[4]["text"] == "deep" and out[5]["n_chars"] == 999_999
    assert html.extracted(spark.createDataFrame([], schema)).collect() == []


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1), (10, [0.0, 1e300], 2), (11, [-0.0, 1e-300], 2)]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    got = sorted((r["vec_id"] if r["vec_id"] is not None else 99, r["n_links"], r["component_id"], r["kept"]) for r in out)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (99, 3, 1, False), (10, 1, 10, True), (11, 1, 10, False), *alone])
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
