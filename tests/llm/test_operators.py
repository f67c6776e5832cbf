"""Operators against brute force, libraries, invariants or held-out accuracy, on the small tables."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import common, embeddings, features, graph, html, licenses, minhash, mixing, packing, quality, queries, suffix, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents").toPandas().sort_values("doc_id")


@pytest.fixture(scope="module")
def by_words():
    return Tokenizer.from_file(WORDS)


odd_text = st.lists(st.sampled_from(list("abthe REing'sdlvm \n\t\x1c\x85\xa0　éÉ́Σςİßﬁ中😀12٣!?.-<|>") + ["<|endoftext|>", "<|startoftext|>", " the", "n't"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(odd_text, st.integers(1, 9))
def test_token_counts_of_odd_texts(by_words, text, chunk):
    expected = len(by_words.encode(text, add_special_tokens=False).ids)
    known = token_counts.counter(WORDS)
    assert token_counts.total(text, known, 1 << 16) == token_counts.total(text, known, chunk) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(odd_text, st.text(st.sampled_from("abcXYZ中文"), min_size=0, max_size=90)), max_size=5), st.integers(1, 60), st.integers(0, 5))
def test_chunk_maps_compose_in_any_grouping(by_words, parts, chars, first):
    """Long runs of letters are cut inside words: maps then take states on."""
    text = "".join(a + b for a, b in parts)
    known = token_counts.counter(WORDS)
    chunks = token_counts.chunks_of(text, known, chars)
    expected = len(by_words.encode(text, add_special_tokens=False).ids)
    whole = token_counts.reduce_pairs(chunks, known)
    assert whole == token_counts.scan(chunks, known)[-1] and whole.emitted == expected and whole.resets and whole.state == known.machine.START
    k = min(first, len(chunks) - 1)
    left, right = (token_counts.reduce_pairs([token_counts.NEUTRAL, *x], known) for x in (chunks[:k], chunks[k:]))
    assert token_counts.compose(left, right, known) == whole


def test_a_word_without_end_is_counted_in_chunks(by_words):
    known = token_counts.counter(WORDS)
    text = "".join(random.Random(9).choices("etaoinshrdlu", k=30_000))
    chunks = token_counts.chunks_of(text, known, 1000)
    assert len(chunks) > 20 and sum(c.resets for c in chunks) == 2
    known.machine._reset()  # states are values: they outlive their numbers
    assert token_counts.reduce_pairs(chunks, known).emitted == len(by_words.encode(text, add_special_tokens=False).ids)


def test_op3(spark, docs, by_words):
    expected = {i: (len(t.encode()), len(e.ids), len(e.ids) > 2048) for i, t, e in zip(docs.doc_id, docs.text, by_words.encode_batch(list(docs.text), add_special_tokens=False), strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op3_token_counts(spark, DATA).collect()} == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("aB \n\té́中\0\x1c\xa0　!") + ["'s", "12", "<|endoftext|>", " the", "  "]), max_size=25).map("".join), max_size=4))
def test_encoder_is_the_library(texts):
    library = Tokenizer.from_file(BYTES)
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(BYTES).encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op5(spark, docs):
    library = Tokenizer.from_file(BYTES)
    ids = {i: np.array([*e.ids, 1], "<u4") for i, e in zip(docs.doc_id, library.encode_batch(list(docs.text), add_special_tokens=False), strict=True)}
    rows = queries.op5_packing(spark, DATA).toPandas()
    assert rows.length.sum() == sum(map(len, ids.values()))
    for r in rows.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
    for i, g in rows.sort_values("start").groupby("doc_id"):
        assert (g.start == g.length.cumsum() - g.length).all() and g.length.sum() == len(ids[i])
    packs = rows.sort_values("offset").groupby("sequence_id")
    assert all((g["offset"] == g.length.cumsum() - g.length).all() for _, g in packs)
    sizes = packs.length.sum()
    assert sizes.max() <= 2048 and sorted(sizes.index) == list(range(len(sizes)))
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding < 0.02 * sizes.sum()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(0, 30), max_size=16))
def test_places_cover_each_piece_once_and_no_pack_overflows(histogram):
    runs = packing.place(histogram, 16)
    packs = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for length, rank, many, first, offset in runs:
        ranks[length] += range(rank, rank + many)
        for p in range(first, first + many):
            packs[p].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items() if c}
    assert sorted(packs) == list(range(len(packs)))
    for places in packs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16


def test_op6(spark, docs):
    rows = queries.op6_mixing(spark, DATA).toPandas().merge(docs[["doc_id", "text", "source"]], on="doc_id")
    assert (rows["size"] == [len(WORD.findall(t)) for t in rows.text]).all() and (rows.taken <= 2 * rows["size"]).all()
    size = rows.groupby("source")["size"].sum()
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size.index))}
    goal, share = 1.5 * size.sum(), {}
    open_ = set(size.index)
    while True:
        level = (goal - sum(2 * size[s] for s in size.index if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        open_ -= over
    share = {s: level * weight[s] if s in open_ else 2 * size[s] for s in size.index}
    for s, g in rows.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(share[s]) and g.source_size.iloc[0] == size[s]
        assert abs(g.taken.sum() - share[s]) <= g["size"].max()
    again = queries.op6_mixing(spark, DATA).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, rows[again.columns].values.tolist()))


def test_mix_of_many_and_of_equal_rows(spark):
    made = spark.range(5000).select((F.col("id") % 3000).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    rows = mixing.mix(made, block=16).toPandas()
    assert len(rows) == 5000
    for _, g in rows.groupby("target"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 50
    taken = mixing.mixed(made, block=16).agg(F.sum(mixing.n_words(F.col("text")))).head()[0]
    assert taken == rows.taken.sum()


def test_targets_of_many_sources(spark):
    """Against the rule itself, with more sources than tasks, sources without words, and null."""
    sizes = {None if i == 0 else f"s{i:04d}" if i % 3 else f"S/{i}é": (i * 7919) % 1000 * (i % 5 > 0) for i in range(300)}
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint"), (3, 1, 2), 1.5, 2.0).collect()}
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    rest, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        open_ -= over
    target |= share
    assert got.keys() == sizes.keys() and all(got[s][0] == sizes[s] and got[s][1] == pytest.approx(target[s]) for s in names)


def brute_links(x: np.ndarray, threshold: float = 0.9):
    near = x @ x.T >= threshold
    np.fill_diagonal(near, True)
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None], len(x)).min(1)
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


def test_op7_with_one_large_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(0, 0.12, (300, 16)), centres[0] + rng.normal(0, 0.05, (120, 16)), rng.standard_normal((80, 16))])
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = embeddings.near_vectors(made, miss=1e-6).orderBy("vec_id").collect()
    links, label = brute_links(x / np.linalg.norm(x, axis=1)[:, None])
    assert [r["n_links"] for r in rows] == links.tolist() and [r["component_id"] for r in rows] == label.tolist()


def test_op7(spark):
    rows = queries.op7_embedding_near_dedup(spark, DATA).orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in common.table(spark, DATA, "embeddings").orderBy("vec_id").collect()], float)
    links, label = brute_links(x / np.linalg.norm(x, axis=1)[:, None])
    assert [r["n_links"] for r in rows] == links.tolist() and [r["component_id"] for r in rows] == label.tolist()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    up = list(range(31))
    for _ in range(31):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: up[i] for a, b in links if a != b for i in (a, b)}


def test_components_of_a_long_chain(spark):
    got = graph.components(spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 201


def base_counts(text):
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many, cover, seen, lines = collections.Counter(runs), set(), set(), 0
    for i, r in enumerate(runs):
        if many[r] > 1:
            cover |= set(range(i, i + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(cover)


def test_op8(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op8_quality(spark, DATA).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        r, expected = rows[i], base_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0]) and not (r["kept"] and r["base_failed"])


def test_op8_agrees_with_labels(spark):
    data = "/root/testdata/sf0.01"
    labels = common.table(spark, data, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = queries.op8_quality(spark, data).join(labels, "doc_id").toPandas()
    assert ((rows["quality"] >= 0.5) == (rows.label == 1)).mean() > 0.9


def test_op9_on_held_out_documents(spark, monkeypatch):
    """Accuracy on documents that training never saw; and that it falls without the network's vectors, or without its recurrence."""
    data, fit, nets = "/root/testdata/sf0.1", toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: nets.append(fit(texts, toxic)) or nets[0])
    rows = queries.op9_toxicity(spark, data).join(common.table(spark, data, "labels"), "doc_id").filter("held_out and toxic is not null")
    rows = rows.join(common.table(spark, data, "documents").select("doc_id", "text"), "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in rows.doc_id) and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    right = (rows.predicted == rows.toxic).mean()
    assert right > 0.95
    bad = rows[rows.toxic == 1]
    assert bad.predicted.mean() > 0.85 and rows[rows.predicted == 1].toxic.mean() > 0.9
    [net], rng = nets, np.random.default_rng(0)

    def without(**changed) -> float:
        held = dict(net.p)
        net.p.update(changed)
        score = toxicity.Scorer(net).scores([t or "" for t in rows.text])
        net.p.update(held)
        return max(((score >= at) == (rows.toxic == 1)).mean() for at in np.quantile(score, np.linspace(0, 1, 100)))

    words = net.p["words"].copy()
    words[1:] = words[1:][rng.permutation(len(words) - 1)]
    assert without(words=words, grams=net.p["grams"][rng.permutation(len(net.p["grams"]))]) < right - 0.06
    assert without(uf=net.p["uf"] * 0, ub=net.p["ub"] * 0) < right - 0.02


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    """What tells long toxic texts apart stands in the middle of them; a document that does not fit is left out whole."""
    rng, seen = random.Random(3), []
    clean = lambda n: " ".join(rng.choices(["house", "tree", "river", "stone", "cloud", "bread"], k=n))
    rows = [(i, clean(2600) + (" v1le filth " if i % 2 else " ") + clean(2600)) for i in range(1, 41)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    fit = toxicity.fit

    def watched(texts, toxic):
        texts = list(texts)
        seen.append([len(t) for t in texts])
        return fit(texts, toxic)

    monkeypatch.setattr(toxicity, "fit", watched)
    got = toxicity.toxicity(docs, labels).collect()
    assert set(seen[0]) == {5200, 5202} and all(r["predicted"] == r["doc_id"] % 2 for r in got)
    toxicity.train(docs, labels, words=12_000)
    assert len(seen[1]) == 4


def test_op8_on_labels_it_has_not_seen(spark):
    data = "/root/testdata/sf0.1"
    labels = common.table(spark, data, "labels")
    apart = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0
    rows = quality.quality(common.table(spark, data, "documents"), labels.filter(~apart)).join(labels.filter(apart).select("doc_id", F.col("quality").alias("label")).filter("label is not null"), "doc_id").toPandas()
    assert len(rows) > 300 and ((rows["quality"] >= 0.5) == (rows.label == 1)).mean() > 0.9


def sets_of(text):
    words = WORD.findall(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("small", [False, True])
def test_op1(spark, monkeypatch, small):
    """small: blocks of a few documents, so that leaders and leftovers have work to do."""
    if small:
        monkeypatch.setattr(minhash, "BLOCK", 3)
        monkeypatch.setattr(minhash, "LEADERS", 1)
        monkeypatch.setattr(minhash, "SHARE", 20)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    texts = {}
    for group in range(12):
        words = rng.choices(vocabulary, k=rng.randint(80, 400))
        for copy in range(rng.choice([1, 2, 5, 12])):
            new = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                new[rng.randrange(len(new))] = f"changed{rng.random()}"
            texts[len(texts)] = " ".join(new)
    texts |= {1000: "", 1001: " \n", 1002: "three words only", 1003: "three  words\nonly", 1004: "three words or"}
    sets = {i: sets_of(t) for i, t in texts.items()}
    up = {i: i for i in texts}
    unsure = set()
    for i in texts:
        for j in texts:
            if i < j:
                same = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) if sets[i] or sets[j] else 1
                if same >= 0.85:
                    a, b = up[i], up[j]
                    up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
                elif same > 0.7:
                    unsure |= {i, j}
    rows = minhash.near_duplicates(spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    sure = [i for i in texts if up[i] not in {up[u] for u in unsure}]
    assert len(sure) > 20 and all(got[i] == up[i] for i in sure)
    assert [(i, j, got[i], got[j]) for i in texts for j in texts if up[i] == up[j] and got[i] != got[j]] == []
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_samples_agree_as_weighted_sets_do():
    rng, sampler = np.random.default_rng(1), minhash.Sampler()
    expected, got = [], []
    for _ in range(60):
        h = np.unique(rng.integers(1, 1 << 63, 400).astype(np.uint64))
        cut = rng.integers(0, 150)
        a, b = h[: h.size - cut], h[cut:]
        wa, wb = rng.uniform(0.7, 3, h.size), None
        wb = wa.copy()
        weights = dict(zip(h.tolist(), wa.tolist(), strict=True))
        both = sum(weights[x] for x in np.intersect1d(a, b).tolist())
        expected.append(both / wa.sum())
        got.append((sampler(a, np.log(wa[: h.size - cut])) == sampler(b, np.log(wb[cut:]))).mean())
    assert abs(np.mean(got) - np.mean(expected)) < 0.03


@pytest.mark.parametrize("shingles", [400, 20_000, 100_000])
def test_samples_agree_in_large_sets_of_a_hot_group(shingles):
    """Shared shingles weigh less than changed ones, as in a group that holds a third of all rows."""
    rng, sampler = np.random.default_rng(2), minhash.Sampler()
    got = []
    for _ in range(8):
        h = np.unique(rng.integers(1, 1 << 63, shingles).astype(np.uint64))
        changed = int(h.size * 0.06)
        a, b = h[changed:], h[: h.size - changed]
        weigh = lambda x: np.log(np.where(np.isin(x, h[changed : h.size - changed]), 0.79, 1.0))  # noqa: B023, E731
        got.append((sampler(a, weigh(a)) == sampler(b, weigh(b))).mean())
    shared, own = 0.79 * (1 - 2 * 0.06), 2 * 0.06
    assert abs(np.mean(got) - shared / (shared + own)) < 0.04 and min(got) > minhash.LIKELY


def test_attached_rows(spark):
    rows = spark.createDataFrame([(k, k * 100 + i) for k in range(6) for i in range(k * 3)], "k bigint, own bigint")
    per = rows.groupBy("k").agg(F.max("own").alias("top")).filter("k <> 2")
    got = graph.attach(rows, per, "k").collect()
    assert sorted(map(tuple, got)) == [(k, k * 100 + i, k * 100 + k * 3 - 1) for k in range(6) if k != 2 for i in range(k * 3)]


def brute_removals(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                cover[s] += 1
                cover[s + width] -= 1
            else:
                seen.add(b[s : s + width])
        gone = np.cumsum(cover)[:-1] > 0
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(rest).hexdigest()
    return out


@pytest.mark.parametrize(("block", "shard", "hot"), [(4 << 20, 1 << 20, 50_000), (30_000, 700, 50_000), (30_000, 700, 2)])
def test_op10(spark, docs, monkeypatch, block, shard, hot):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", block * 2)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    rows = suffix.removals(common.table(spark, DATA, "documents"), hot_uses=hot).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute_removals(list(zip(docs.doc_id.tolist(), docs.text, strict=True)), 100)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabé\0\n"), max_size=80), min_size=1, max_size=5), st.sampled_from([(7, 3), (12, 5), (20, 20)]))
def test_repeats_of_few_symbols(spark, texts, shape):
    width, gram = shape
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = suffix.removals(made, width=width, gram=gram).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute_removals(list(enumerate(texts)), width)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=14).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), min_size=1, max_size=4), st.integers(1, 14))
def test_merge_gives_order_common_prefixes_and_intervals(shards, depth):
    strings = [x for s in shards for x in s]
    owner, offset, common = suffix.merged(shards, depth)
    rows = [strings[o][f:] for o, f in zip(owner.tolist(), offset.tolist(), strict=True)]
    assert sorted(zip(owner.tolist(), offset.tolist(), strict=True)) == [(o, f) for o, x in enumerate(strings) for f in range(len(x) - depth + 1)]
    assert [r[:depth] for r in rows] == sorted(r[:depth] for r in rows)
    assert common.tolist() == [len(os.path.commonprefix([a[:depth], b[:depth]])) if i else 0 for i, (a, b) in enumerate(zip([b"", *rows], rows, strict=False))][: len(rows)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=6))
def test_transform_of_a_shard(strings):
    bwt, string, offset = suffix.transform(strings)
    rows = sorted(([b + 1 for b in strings[s][o:]] + [0, s], s, o) for s in range(len(strings)) for o in range(len(strings[s]) + 1))
    assert [(s, o) for _, s, o in rows] == list(zip(string.tolist(), offset.tolist(), strict=True))
    assert bwt.tolist() == [strings[s][o - 1] + 1 if o else 0 for _, s, o in rows]
    back = suffix.preceding(bwt)
    place = {(s, o): i for i, (_, s, o) in enumerate(rows)}
    assert all(back[i] == place[s, o - 1] for i, (_, s, o) in enumerate(rows) if o)


def test_cut_texts_and_columns(spark):
    part = "é" + "".join(map(chr, range(0x100, 0x13B)))
    made = spark.createDataFrame([(1, part + "one", 63, "x"), (2, "a" + part + "two", 64, None), (3, None, None, "z")], "doc_id bigint, text string, n_chars bigint, row string")
    rows = {r["doc_id"]: r for r in suffix.cut_out(made).collect()}
    assert rows[1]["text"] == part + "one" and rows[2]["text"] == "atwo" and rows[2]["n_chars"] == 4 and rows[3]["text"] is None and rows[3]["row"] == "z"


PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("a <b> b </b> c\n d", "a b c d"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"),
    ("<ol start=9><li>x<li>y<p>more</ol>", "9. x\n10. y\n\n    more"),
    ("<table><tr><th>k<th>value<tr><td>long key<td>v</table>after", "k         value\nlong key  v\n\nafter"),
    ("<table><caption>c</caption><tr><td rowspan=2>a<td>b<tr><td>d</table>", "c\na  b\n   d"),
    ("<table><tr><td colspan=2>wide cell here<td>z<tr><td>1<td>2<td>3</table>", "wide cell here  z\n1  2  3"),
    ("<div>a</div><div>b</div><h1>t</h1>u", "a\nb\n\nt\n\nu"),
    ("<head><title>no</title></head><body>yes<script>no</script><style>no</style><template>no</template>", "yes"),
    ("<p hidden>no</p><p style='color:red; DISPLAY : none'>no</p><span style='visibility:hidden'>no</span>yes", "yes"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<pre> a\n   b </pre>", " a\n   b"),
    ("&lt;x&gt; &amp; &copy; &#233;", "<x> & © é"),
    ("<p>a<div>b</p>c</div>", "a\n\nb\n\nc"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("</p></table>x</td>", "x"),
    ("<div>" * 5000 + "<p hidden>secret</p>seen", "seen"),
    ("<div>" * 450 + "<div hidden>" + "<b>" * 600 + "secret" + "</b>" * 600 + "</div>" + "</div>" * 450 + "seen", "seen"),
    ("<table><tr><td>" * 300 + "deep", "deep"),
    ("<p>a<span>" + "<i>" * 3000 + "<script>no</script><style>no</style>b", "ab"),
    ("<p>x <svg><title>no</title><desc/><defs><text>no</text></defs><text>label</text><text>two</text></svg> y", "x label two y"),
    ("<math><mfrac><mi>a</mi><mi>b</mi></mfrac><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "ab =1"),
    ("<svg><foreignObject><p>one<p>two</foreignObject></svg>", "one\n\ntwo"),
]


@pytest.mark.parametrize(("page", "text"), PAGES, ids=range(len(PAGES)))
def test_pages(page, text):
    assert html.visible_text(page) == text


def test_deep_lists_keep_their_text():
    lines = html.visible_text("".join(f"<ul><li>item{i}" for i in range(2000))).split("\n")
    assert [x.strip(" -") for x in lines] == [f"item{i}" for i in range(2000)] and max(map(len, lines)) < 120


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["div", "span", "p", "li", "ul", "table", "tr", "td", "b", "svg", "math", "dl", "dd", "blockquote"]), st.booleans(), st.booleans()), max_size=30), st.integers(0, 2))
def test_hidden_text_never_shows_and_shown_text_always_does(tags, at):
    """Random nests of elements, all ended in order: each holds a word of its own, hidden if it or one around it is."""
    page, expected, hidden, open_ = "", [], 0, []
    for i, (tag, hide, end) in enumerate(tags):
        if tag in ("p", "li", "tr", "td", "table", "dd", "svg", "math"):
            tag = "section"  # only elements that no other element ends
        page += f"<{tag}{' hidden' if hide else ''}> w{i} "
        open_.append((tag, hide))
        hidden += hide
        if not hidden:
            expected.append(f"w{i}")
        if end:
            tag, hide = open_.pop()
            page += f"</{tag}>"
            hidden -= hide
    words = [w for w in html.visible_text(page).split() if w != "-"]
    assert words == expected


def test_op4_shows_every_visible_word(spark):
    hidden = re.compile(r"<head>.*?</head>|<script>.*?</script>|<!--.*?-->", re.S)
    import html as entities

    rows = {r["page_id"]: r for r in queries.op4_html_extraction(spark, DATA).collect()}
    for r in common.table(spark, DATA, "pages").collect():
        words = entities.unescape(re.sub(r"<[^>]*>", " ", hidden.sub("", r["html"]))).split()
        assert [w for w in rows[r["page_id"]]["text"].split() if w != "-"] == words


def test_op2(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    expected = c.execute(queries.ORACLE_SQL["op2_license_scan"]).fetchall()
    assert sorted(map(tuple, queries.op2_license_scan(spark, DATA).collect()), key=str) == sorted(expected, key=str)


def test_licences_are_known_in_other_dress(spark):
    mit = licenses.LICENCES["MIT"]
    dressed = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENSE,").replace("\n", "  \n\t")
    isc = licenses.LICENCES["ISC"].replace("License", "Licence")
    rows = licenses.licences(spark.createDataFrame([(1, mit), (2, dressed), (3, mit + " x"), (4, "ISC Licence\n\n" + isc), (5, "text\nreleased under the mit licence\nmore\nLicensed under CC BY 4.0!")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["license_id"] for r in rows] == ["MIT", "MIT", None, "ISC", None] and rows[4]["notice_ids"] == "CC-BY-4.0,MIT"


def test_word_hashes_tell_words_apart():
    data = np.frombuffer(b"a ab a b\tab aba", np.uint8)
    h = features.word_hashes(data, *features.words_of(data)).tolist()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h)) == 4


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(3000)] + ["vile"] * 40
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 300))] for _ in range(120)]
    net = toxicity.fit(texts, np.array(["vile" in t for t in texts], np.int64), rounds=2)
    whole = [" ".join(t) for t in texts]
    expected = toxicity.Scorer(net).scores(whole)
    alone = np.concatenate([toxicity.Scorer(net).scores([t]) for t in whole])
    monkeypatch.setattr(toxicity, "REMEMBERED", 700)
    scorer = toxicity.Scorer(net)
    few = np.concatenate([scorer.scores([t]) for t in whole])
    assert np.allclose(expected, alone, atol=1e-5) and np.allclose(expected, few, atol=1e-5)
