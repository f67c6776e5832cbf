"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs of a word: a vector of its own if it is in the vocabulary of the sample, and the sum of
the vectors of its character n-grams (hashed, word ends marked). One component of
either starts at how far the word or n-gram leans to toxic documents in the sample,
the others at noise; all are trained. Texts are scored in overlapping windows, all of
them; a document is as toxic as its worst window. Platt's scaling on documents kept
apart makes the score a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import durable, give_back, small_batches
from cairn.llm.quality import sigmoid

#: A word has a letter; digits within it stay, as they stand for letters where words are disguised.
WORDS = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
WINDOW, STRIDE = 64, 48
HIDDEN, DIM = 12, 6
GRAMS, GRAM_BITS = (3, 4, 5, 6), 17
VOCABULARY, LEAST_WORDS = 4096, 24
#: Standard errors by which a word or n-gram has to lean to start as toxic.
CLEAR = 2.0
#: Of either label, documents and words of whole texts that the network learns from.
SAMPLE, SAMPLE_WORDS = 2000, 800_000
REMEMBERED = 1 << 17
BATCH = 1024
f32 = np.float32


def spans(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words that leave none out; one empty window for none."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, one word after the other, and how many each word has (the empty one none)."""
    coded = [f"<{w}>".encode() for w in words]
    sizes = np.array([len(c) for c in coded])
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    buckets, owners = [], []
    for n in GRAMS:
        many = np.maximum(sizes - n + 1, 0)
        owner = np.repeat(np.arange(len(words)), many)
        at = np.arange(owner.size) - np.repeat(np.cumsum(many) - many, many) + first[owner]
        h = np.full(at.size, n, np.uint32)
        for i in range(n):
            h = (h ^ data[at + i]) * np.uint32(0x01000193) + np.uint32(0x9E3779B1)
        buckets.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - GRAM_BITS))
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def tanh(x):
    return np.tanh(x, out=x)


def squash(x):
    """Logistic function, in place."""
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """p: word vectors, gram vectors, and for either direction input weights, bias, recurrent weights; attention and output weights."""

    def __init__(self, vocabulary: dict[str, int], p: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, p
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """One row of inputs for each word, and what its gradient needs."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        buckets, many = grams_of(words)
        ends = np.cumsum(many)
        chars, some = np.zeros((len(words), DIM), f32), many > 0
        if some.any():
            chars[some] = np.add.reduceat(self.p["grams"][buckets], (ends - many)[some], axis=0)
        return np.concatenate((self.p["words"][ids], chars), 1), (ids, buckets, many)

    def table(self, words: list[str]) -> np.ndarray:
        """Inputs of many words."""
        return np.concatenate([self.inputs(words[i : i + 8192])[0] for i in range(0, len(words), 8192)])

    def run(self, inputs: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, windows, HIDDEN); inputs: (steps, windows, 3 HIDDEN), already weighted."""
        steps, rows, _ = inputs.shape
        u = self.p["u" + way]
        h = np.zeros((rows, HIDDEN), f32)
        out = np.empty((steps, rows, HIDDEN), f32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = h @ u
            gates = squash(inputs[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = tanh(inputs[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            after = new + z * (h - new)
            if way == "b":
                after *= mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, new, a[:, 2 * HIDDEN :]))
            h = after
            out[t] = h
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights (steps, windows), pooled states, logits."""
        score = states @ self.p["att"]
        score = np.where(mask > 0, score, f32(-30))
        score -= score.max(0)
        weight = np.exp(score)
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return weight, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate((self.run(forward, mask, "f"), self.run(backward, mask, "b")), 2)
        return self.pooled(states, mask)[2]

    def learn(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of x. x: inputs of the words; index: (steps, windows) into x."""
        p, g = self.p, {}
        kept = {"f": [], "b": []}
        states = np.concatenate([self.run(x[index] @ p["w" + w] + p["b" + w], mask, w, kept[w]) for w in "fb"], 2)
        weight, pooled, logit = self.pooled(states, mask)
        d = ((sigmoid(logit) - y) * importance).astype(f32) / f32(len(y))
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], f32)
        d_pooled = d[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        along = np.einsum("tbh,bh->tb", states, d_pooled)
        d_score = weight * (along - (weight * along).sum(0))
        g["att"] = np.einsum("tb,tbh->h", d_score, states)
        d_states += d_score[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for i, w in enumerate("fb"):
            u, grad_u = p["u" + w], np.zeros_like(p["u" + w])
            d_h = np.zeros((index.shape[1], HIDDEN), f32)
            d_in = np.zeros((*index.shape, 3 * HIDDEN), f32)
            for t, h, z, r, new, a in reversed(kept[w]):
                d_h = d_h + d_states[t, :, i * HIDDEN : (i + 1) * HIDDEN]
                if w == "b":
                    d_h = d_h * mask[t][:, None]
                d_new = d_h * (1 - z) * (1 - new * new)
                d_a = np.concatenate((d_h * (h - new) * z * (1 - z), d_new * a * r * (1 - r), d_new * r), 1)
                d_in[t] = d_a
                d_in[t, :, 2 * HIDDEN :] = d_new
                grad_u += h.T @ d_a
                d_h = d_h * z + d_a @ u.T
            flat = d_in.reshape(-1, 3 * HIDDEN)
            g["u" + w], g["w" + w], g["b" + w] = grad_u, x[index].reshape(-1, 2 * DIM).T @ flat, flat.sum(0)
            np.add.at(dx, index.reshape(-1), flat @ p["w" + w].T)
        return g, dx


def windows_of(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, one after the other: each window's text, first word and length."""
    rows, base = [], 0
    for i, n in enumerate(sizes):
        rows += [(i, base + a, b - a) for a, b in spans(n)]
        base += n
    return tuple(np.array(rows, np.int64).reshape(-1, 3).T)


def laid_out(slots: np.ndarray, first: np.ndarray, length: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows): the words' slots, and where there are words. An empty window has one blank word."""
    steps = max(1, int(length.max(initial=1)))
    step = np.arange(steps)[:, None]
    inside = step < length
    index = np.full(inside.shape, blank, np.int64)
    if slots.size:
        index = np.where(inside, slots[np.minimum(first + step, slots.size - 1)], blank)
    return index, np.maximum(inside, (step == 0) & (length == 0)).astype(f32)


def leaning(items: Iterable[np.ndarray], n: int, toxic: np.ndarray) -> np.ndarray:
    """How far each of n items leans to toxic documents, in standard errors; items: those of each document, once each."""
    count = np.zeros((2, n))
    for i, y in zip(items, toxic, strict=True):
        count[y, i] += 1
    good, bad = count[0] * max(1, toxic.sum()) / max(1, (1 - toxic).sum()), count[1]
    return np.where(bad > 1, (bad - good) / np.sqrt(bad + good + 3), 0)


def fit(texts: Iterable[list[str]], toxic: np.ndarray, rounds: int = 12, seed: int = 11) -> Network | None:
    """texts: the words of each. None if toxic has one value only."""
    if toxic.size < 2 or toxic.min() == toxic.max():
        return None
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    of_text = [np.array([number.setdefault(w, len(number)) for w in t], np.int32) for t in texts]
    every = list(number)
    apart = np.arange(len(of_text)) % 5 == 0
    if toxic[apart].min(initial=1) == toxic[apart].max(initial=0) or toxic[~apart].min() == toxic[~apart].max():
        apart[:] = False
    learnt = [np.unique(t) for t, a in zip(of_text, apart, strict=True) if not a]
    by_word = leaning(learnt, len(every), toxic[~apart])
    order = np.argsort(-by_word, kind="stable")[:VOCABULARY]
    clear = order[(by_word[order] > CLEAR) | (by_word[order] > 1.5) & (np.arange(order.size) < LEAST_WORDS)]
    vocabulary = {every[w]: i + 1 for i, w in enumerate(clear.tolist())}
    buckets, many = grams_of(every)
    buckets, ends = buckets.astype(np.int32), np.cumsum(many)
    grams_in = lambda t: np.unique(np.concatenate([buckets[ends[i] - many[i] : ends[i]] for i in t.tolist()] or [buckets[:0]]))
    by_gram = leaning(map(grams_in, learnt), 1 << GRAM_BITS, toxic[~apart])
    del buckets, ends, many, learnt, number
    p = {"words": rng.normal(0, 0.02, (VOCABULARY + 1, DIM)).astype(f32), "grams": rng.normal(0, 0.005, (1 << GRAM_BITS, DIM)).astype(f32)}
    p["words"][0] = 0
    p["words"][:, 0], p["grams"][:, 0] = 0, 0
    p["words"][1 : clear.size + 1, 0] = np.minimum(by_word[clear], 8) / 4
    p["grams"][:, 0] = np.where(by_gram > CLEAR, np.minimum(by_gram, 8) / 12, 0)
    for w in "fb":
        p["w" + w] = rng.normal(0, 0.4, (2 * DIM, 3 * HIDDEN)).astype(f32)
        p["u" + w] = rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)).astype(f32)
        p["b" + w] = np.zeros(3 * HIDDEN, f32)
    p["att"], p["out"], p["bias"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(f32), rng.normal(0, 0.3, 2 * HIDDEN).astype(f32), np.zeros(1, f32)
    net = Network(vocabulary, p)
    slots = np.concatenate([*of_text, np.empty(0, np.int32)])
    owner, first, length = windows_of([len(t) for t in of_text])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    share = np.clip(toxic[~apart].mean(), 0.02, 0.98)
    importance = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)).astype(f32)
    turns = 0
    x = net.table([*every, ""])
    worst = x[:, 0] + x[:, DIM]  # at first, the windows that lean most
    score = np.array([worst[slots[a : a + n]].max(initial=0) for a, n in zip(first, length, strict=True)])
    rate, batch = 0.02, 64
    per_round = max(1, -(-int((~apart).sum()) // batch))
    rounds = max(rounds, -(-240 // per_round))
    looks = {int(round(rounds * k / 10)) for k in range(1, 10)}
    for turn in range(rounds):
        if turn in looks:
            score = all_logits(net, x, slots, first, length)
        order = np.lexsort((-score, owner))
        best = order[np.concatenate(([True], np.diff(owner[order]) > 0))]
        chosen_windows = rng.permutation(best[~apart[owner[best]]])
        for at in range(0, chosen_windows.size, batch):
            these = chosen_windows[at : at + batch]
            index, mask = laid_out(slots, first[these], length[these], len(every))
            used, place = np.unique(index, return_inverse=True)
            part, (word_ids, gram_ids, gram_n) = net.inputs([every[i] if i < len(every) else "" for i in used])
            g, dx = net.learn(part, place.reshape(index.shape), mask, toxic[owner[these]], importance[owner[these]])
            g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
            np.add.at(g["words"], word_ids, dx[:, :DIM])
            g["words"][0] = 0
            np.add.at(g["grams"], gram_ids, np.repeat(dx[:, DIM:], gram_n, axis=0))
            turns += 1
            now = rate * (1 - turn / rounds)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v *= f32(min(1, 1 / (norm + 1e-9)))
                m, s = moments[k]
                m *= f32(0.9)
                m += f32(0.1) * v
                s *= f32(0.99)
                s += f32(0.01) * v * v
                own = now * {"words": 0.1, "grams": 0.02}.get(k, 0.5)
                p[k] -= (f32(own / (1 - 0.9**turns)) * m / (np.sqrt(s / f32(1 - 0.99**turns)) + f32(1e-5))).astype(f32)
        x = net.table([*every, ""])
    score = all_logits(net, x, slots, first, length)
    worst = np.full(len(of_text), -np.inf)
    np.maximum.at(worst, owner, score)
    calibrate(net, worst[apart] if apart.any() else worst, toxic[apart] if apart.any() else toxic, share)
    return net


def all_logits(net: Network, x: np.ndarray, slots: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits of all windows. x: inputs by slot, the blank word's last."""
    tables = [(x @ net.p["w" + w] + net.p["b" + w]).astype(f32) for w in "fb"]
    return logits_of(net, tables, slots, first, length, len(x) - 1)


def logits_of(net: Network, tables: list[np.ndarray], slots: np.ndarray, first: np.ndarray, length: np.ndarray, blank: int) -> np.ndarray:
    out = np.empty(len(first), np.float64)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), BATCH):
        these = order[at : at + BATCH]
        index, mask = laid_out(slots, first[these], length[these], blank)
        out[these] = net.logits(tables[0][index], tables[1][index], mask)
    return out


def calibrate(net: Network, z: np.ndarray, y: np.ndarray, share: float) -> None:
    """Platt's scaling, rows weighted as the classes of the sample are."""
    bad = y.sum()
    target = np.where(y > 0, (bad + 1) / (bad + 2), 1 / (y.size - bad + 2))
    scale, shift = 1.0, 0.0
    for _ in range(40):
        q = sigmoid(scale * z + shift)
        r, k = q - target, np.maximum(q * (1 - q), 1e-9)
        h = np.array([[(k * z * z).sum() + 1e-3, (k * z).sum()], [(k * z).sum(), k.sum() + 1e-3]])
        ds, db = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        scale, shift = scale - np.clip(ds, -0.5, 0.5), shift - np.clip(db, -1, 1)
    net.scale, net.shift = float(max(scale, 0.05)), float(shift)


class Scorer:
    """Scores texts; remembers the weighted inputs of the latest words."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.tables = [np.zeros((REMEMBERED + 1, 3 * HIDDEN), f32) for _ in "fb"]
        self._fill([""], np.array([REMEMBERED]))

    def _fill(self, words: list[str], at: np.ndarray) -> None:
        x, _ = self.net.inputs(words)
        for table, w in zip(self.tables, "fb", strict=True):
            table[at] = x @ self.net.p["w" + w] + self.net.p["b" + w]

    def slots(self, words: list[str]) -> np.ndarray:
        new = list({*words} - self.slot.keys())
        if len(self.slot) + len(new) > REMEMBERED:
            self._clear()
            new = list({*words})
        if new:
            at = np.arange(len(self.slot), len(self.slot) + len(new))
            self.slot.update(zip(new, at.tolist(), strict=True))
            self._fill(new, at)
        return np.array(list(map(self.slot.__getitem__, words)), np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        words, sizes = [], []
        for t in texts:
            found = WORDS.findall(t.lower())
            words += found
            sizes.append(len(found))
        owner, first, length = windows_of(sizes)
        worst = np.full(len(texts), -np.inf)
        # a very long text may have more words than are remembered at once: by parts, all the same
        for a in range(0, len(first), 2000):
            part = slice(a, a + 2000)
            lo, hi = int(first[a]), int((first[part] + length[part]).max())
            slots = self.slots(words[lo:hi])  # first: it may make new tables
            z = logits_of(self.net, self.tables, slots, first[part] - lo, length[part], REMEMBERED)
            np.maximum.at(worst, owner[part], z)
        return sigmoid(self.net.scale * worst + self.net.shift)


def remainder() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = SAMPLE_WORDS) -> Network | None:
    """The network, from at most `sample` labelled documents of either label, none of them held out, and at most `words` words of these.

    Those that come first by a hash of their id are taken, one text for an id. Texts are taken whole: a document whose
    words no longer fit is left out, and the next one is looked at. So what comes to the driver is bounded, whatever the
    texts' length.
    """
    of = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder() != 0))
    of = of.groupBy("doc_id").agg(F.max("label").alias("label"))
    first = [of.filter(F.col("label") == y).orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(first[0].unionAll(first[1])), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [WORDS.findall(cell.as_py().lower()) for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([len(w) for w in found], pa.int64()), pa.array([" ".join(w) for w in found], pa.string())], names=["doc_id", "label", "n", "words"])

    found = durable(rows.mapInArrow(run, "doc_id string, label int, n bigint, words string"))
    sizes = sorted(found.select("doc_id", "label", "n").collect(), key=lambda r: (hash_of(r["doc_id"]), r["doc_id"]))
    if not sizes:
        return None
    taken, room = [], [words, words]
    for r in sizes:
        if r["n"] <= room[r["label"]]:
            room[r["label"]] -= r["n"]
            taken.append(r)
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in taken], "doc_id string")
    texts = {r["doc_id"]: r["words"] for r in found.select("doc_id", "words").join(F.broadcast(wanted), "doc_id").toLocalIterator()}
    return fit((texts.pop(r["doc_id"]).split() for r in taken), np.array([r["label"] for r in taken], np.int64))


def hash_of(key: str) -> int:
    import zlib

    return zlib.crc32(key.encode())


def shipped(docs: DataFrame, net: Network):
    return docs.sparkSession.sparkContext.broadcast((net.vocabulary, {k: v.astype(np.float32) for k, v in net.p.items()}, net.scale, net.shift))


def unpacked(sent) -> Scorer:
    vocabulary, p, scale, shift = sent.value
    net = Network(vocabulary, p)
    net.scale, net.shift = scale, shift
    return Scorer(net)


def scores_of(scorer: Scorer, column) -> np.ndarray:
    """The scores of a column of texts, by parts of bounded size; nulls are empty."""
    scores, texts, chars = [np.empty(0)], [], 0
    for cell in column:
        text = cell.as_py() or ""
        texts.append(text)
        chars += len(text)
        if chars > 600_000:
            scores.append(scorer.scores(texts))
            texts, chars = [], 0
    if texts:
        scores.append(scorer.scores(texts))
    return np.concatenate(scores)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under threshold; all where the labels have one value only.

    Null, empty and very long texts and repeated rows are scored as in toxicity(), each row by itself; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    net = train(docs, labels, sample)
    if net is None:
        return docs
    sent, at = shipped(docs, net), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = unpacked(sent)
        for batch in batches:
            yield batch.filter(pa.array(scores_of(scorer, batch.column(at)) < threshold))
        del scorer
        give_back()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    score: the probability of label 1, from the text alone; 0 for all where the
    labels have one value only. predicted: 1 at threshold or more. Null and empty
    texts have one empty window and are scored as such; very long ones are scored in all their windows. A null id is not held out. Repeated rows stay, one
    row out for each row in; other columns are not read; an empty table gives an
    empty one. Nothing is shuffled but the sample.
    """
    small_batches(docs.sparkSession)
    net = train(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    if net is None:
        return made.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = shipped(docs, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = unpacked(sent)
        for batch in batches:
            score = scores_of(scorer, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        del scorer
        give_back()

    return made.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
