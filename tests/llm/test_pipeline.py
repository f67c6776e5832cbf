"""Each stage against brute force, on its own input, and all of them in a row."""

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import common, mixing, queries
from tests.llm.test_operators import WORD, sets_of

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of each stage, as written and read again."""
    docs, out = common.table(spark, DATA, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        made = common.durable(stage(spark, docs, DATA))
        out.append((docs.toPandas(), made.toPandas()))
        docs = made
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash near-dedup", "suffix-array dedup", "mixing", "packing"]
    assert all(list(after.columns) == COLUMNS for _, after in stages[:-1])


def test_toxicity_keeps_what_the_query_predicts_clean(spark, stages):
    before, after = stages[0]
    clean = {r["doc_id"] for r in queries.op9_toxicity(spark, DATA).collect() if not r["predicted"]}
    assert sorted(after.doc_id) == sorted(clean) and len(after) > 0.8 * len(before)


def test_near_duplicates(stages):
    before, after = stages[1]
    sets = {i: sets_of(t) for i, t in zip(before.doc_id, before.text, strict=True)}
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and (sets[i] or sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    assert sorted(after.doc_id) == sorted(set(up.values()))
    assert after.merge(before, on=COLUMNS).shape[0] == len(after)


def test_repeated_passages(stages):
    before, after = stages[2]
    seen, expected = set(), {}
    for i, t in sorted(zip(before.doc_id, before.text, strict=True)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        expected[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    assert dict(zip(after.doc_id, after.text, strict=True)) == expected and (after.n_chars == after.text.str.len()).all()


def test_mixing(spark, stages):
    before, after = stages[3]
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert after.groupby("doc_id").size().to_dict() == {i: n for i, n in taken.items() if n}
    sizes = before.set_index("doc_id").text.map(lambda t: len(WORD.findall(t)))
    assert abs(sizes[after.doc_id].sum() - 1.5 * sizes.sum()) < 0.1 * sizes.sum()


def test_packing(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert after.length.sum() == sum(len(e.ids) + 1 for e in library.encode_batch(list(before.text), add_special_tokens=False))
    assert (after.start == 0).sum() == len(before) and after.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark, stages):
    before = common.made()
    rows = corpus_pipeline.run(spark, DATA).toPandas()
    assert common.made() - before <= 4  # the last stage's input and its own folders: all others are gone
    assert sorted(map(tuple, rows[["doc_id", "start", "length", "ids_crc32"]].values.tolist())) == sorted(map(tuple, stages[4][1][["doc_id", "start", "length", "ids_crc32"]].values.tolist()))
