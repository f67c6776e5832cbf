"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words, weighted by 1 + ln(1 + ln(tf)) and a damped idf. Document
frequencies are counted over all texts in a table of 2**22 buckets of hashed shingles; the table's size
is fixed, and as the idf no longer falls below one document in a thousand, what shares a bucket by
chance (about one in 8000 documents of 500 words, at any size) does not move it. The idf runs from 3/4 to 1
only: with the full logarithm, the changed words of a near copy would outweigh
all it shares with a large group of copies, and take it out of the group.

Samples make bands, bands make buckets. Within a bucket, pairs whose samples agree
often enough tie candidates together (a spanning forest, not all pairs); large buckets in blocks, as large groups below. Each group
of candidates is then verified from whole texts by exact weighted Jaccard similarity, from
the likeliest pair down, skipping pairs that are already tied. Groups too
large for one task are verified against a block of leaders; what no leader holds is
compared with all the rest, in blocks. The classes are the connected components of verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import durable, fresh, give_back, identity, row_hash, small_batches
from cairn.llm.features import grams, mixed, word_hashes, words_of
from cairn.llm.graph import attach, components

SHINGLE = 5
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
POOL = 4096
LIKELY = 0.6
BLOCK, LEADERS = 1024, 512
DF_BITS, DF_PARTS = 22, 64
RARE = 1000.0
STRIP = 256
#: Rows of buckets that are looked through together.
SHARE = 200_000
LINKS = "a binary, b binary"


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and how often each occurs. A shorter text is one shingle; one without words has none."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    h = word_hashes(data, *words_of(data))
    if not h.size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(grams(h, min(SHINGLE, h.size)), return_counts=True)


def log_weights(found: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """idf: a byte for each bucket of shingles."""
    share = idf[(found >> np.uint64(64 - DF_BITS)).astype(np.int64)] / 255.0
    return np.log((1 + np.log1p(np.log(times))) * (0.75 + 0.25 * share))


class Sampler:
    """Consistent weighted samples. A shingle takes its random numbers r, c and beta from pools, each by bits of its hash of their own.

    Shingles that share one of the three still differ in another: where r and beta are a shingle's own, it
    wins among those of one c in proportion to its weight (r times a uniform number is exponential, so its tail
    beyond T is weight over T), as it does among all.
    """

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, (POOL, SAMPLES)).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (POOL, SAMPLES))).astype(np.float32)
        self.beta = rng.uniform(0, 1, (POOL, SAMPLES)).astype(np.float32)
        self.salt = rng.integers(1, 1 << 62, SAMPLES).astype(np.uint64)

    def __call__(self, found: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The samples of a weighted set, 64 bits each."""
        best = np.full(SAMPLES, np.inf, np.float32)
        out = np.zeros(SAMPLES, np.uint64)
        columns = np.arange(SAMPLES)
        for at in range(0, found.size, 2048):
            part = found[at : at + 2048]
            bits = mixed(part)
            of_r, of_c, of_beta = (((bits >> np.uint64(shift)) & np.uint64(POOL - 1)).astype(np.int64) for shift in (0, 20, 40))
            beta = self.beta[of_beta]
            step = np.floor(logs[at : at + 2048, None].astype(np.float32) * self.inverse[of_r] + beta)
            value = self.log_c[of_c] - self.r[of_r] * (step - beta + 1)
            low = value.argmin(0)
            lowest = value[low, columns]
            better = lowest < best
            best[better] = lowest[better]
            chosen = part[low] ^ (step[low, columns].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[better] = chosen[better]
        return mixed(out + self.salt)


def bands(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(BANDS, np.uint64)
        for i in range(ROWS):
            out = out * np.uint64(0xBF58476D1CE4E5B9) + samples.reshape(BANDS, ROWS)[:, i]
    return mixed(out).astype(np.int64)


def plain(text: Column) -> Column:
    """Words with one space between."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))


def frequencies(texts: DataFrame, documents: int) -> np.ndarray:
    """A byte of idf for each bucket of hashed shingles, from all texts (column plain)."""
    import zstandard

    width = (1 << DF_BITS) // DF_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(1 << DF_BITS, np.uint32)
        for batch in batches:
            for cell in batch.column(0):
                buckets = (shingles(cell.as_py())[0] >> np.uint64(64 - DF_BITS)).astype(np.int64)
                table[buckets[np.concatenate(([True], np.diff(buckets) > 0))] if buckets.size else buckets] += 1
        if table.any():
            pack = zstandard.ZstdCompressor(1).compress
            parts = [pack(table[i * width : (i + 1) * width].astype("<u8").tobytes()) for i in range(DF_PARTS)]
            salt = TaskContext.get().partitionId() % 256
            yield pa.RecordBatch.from_arrays([pa.array(range(DF_PARTS), pa.int32()), pa.array([salt] * DF_PARTS, pa.int32()), pa.array(parts, pa.binary())], names=["part", "salt", "counts"])
        del table
        give_back()

    def added(group: pa.Table) -> tuple[int, np.ndarray]:
        total = np.zeros(width, np.uint64)
        unpack = zstandard.ZstdDecompressor().decompress
        for x in group["counts"]:
            total += np.frombuffer(unpack(x.as_py()), "<u8")
        return group["part"][0].as_py(), total

    def add(group: pa.Table) -> pa.Table:
        part, total = added(group)
        return pa.table({"part": pa.array([part], pa.int32()), "counts": pa.array([zstandard.ZstdCompressor(1).compress(total.tobytes())], pa.binary())})

    def finish(group: pa.Table) -> pa.Table:
        part, total = added(group)
        share = np.clip(np.log(documents / np.maximum(total, 1)) / np.log(RARE), 0, 1)
        return pa.table({"part": pa.array([part], pa.int32()), "idf": pa.array([np.round(255 * share).astype(np.uint8).tobytes()], pa.binary())})

    summed = texts.select("plain").mapInArrow(count, "part int, salt int, counts binary").groupBy("part", "salt").applyInArrow(add, "part int, counts binary")
    out = np.full(1 << DF_BITS, 255, np.uint8)
    for r in summed.groupBy("part").applyInArrow(finish, "part int, idf binary").collect():  # 4 MB, whatever the input
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["idf"], np.uint8)
    return out


def agreeing(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of samples (a byte each) that agree in LIKELY of them or more, and in how many."""
    least = int(np.ceil(LIKELY * SAMPLES))
    for at in range(0, len(left), STRIP):
        same = np.zeros((len(left[at : at + STRIP]), len(right)), np.uint8)
        for k in range(SAMPLES):
            same += left[at : at + STRIP, k][:, None] == right[:, k][None]
        i, j = np.nonzero(same >= least)
        yield i + at, j, same[i, j]


class Ties:
    """Which of n rows are tied."""

    def __init__(self, start: list[int]):
        self.up = start

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def links(self, heads: list[int]) -> list[tuple[int, int]]:
        """From the first of each tree to each of heads in it. Stars, so that components are found in few rounds."""
        return [(self.root(i), i) for i in heads if self.root(i) != i]


def tied_rows(tied: list) -> Ties:
    """Rows with one value are tied."""
    first: dict = {}
    return Ties([first.setdefault(x, i) for i, x in enumerate(tied)])


def forest(samples: np.ndarray, tied: list) -> list[tuple[int, int]]:
    """Links that tie what the rows' likely pairs tie, and is not tied yet: from the first row of each tree to the first of each class in it."""
    ties = tied_rows(tied)
    heads = [i for i, up in enumerate(ties.up) if up == i]
    for i, j, _ in agreeing(samples, samples):
        for x, y in zip(i[i < j].tolist(), j[i < j].tolist(), strict=True):
            ties.tie(x, y)
    return ties.links(heads)


def led(rows: DataFrame) -> DataFrame:
    """rows (id, members) once for each job: one job for a group of 2 LEADERS or fewer; else its first block of leaders with each of the others."""
    blocks = F.ceil(F.col("members") / LEADERS)
    block = F.pmod(F.xxhash64("id"), blocks)
    job = F.when(F.col("members") <= 2 * LEADERS, F.array(F.lit(0).cast("bigint")))
    return rows.withColumn("job", F.explode(job.when(block == 0, F.sequence(F.lit(1).cast("bigint"), blocks - 1)).otherwise(F.array(block))))


def open_groups(rows: DataFrame, group: str) -> DataFrame:
    """Of rows (group, part), groups that leaders did not tie together: their largest part, and blocks of what is outside it and of all."""
    parts = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    whole = parts.groupBy(group).agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all"))
    return whole.filter(F.col("top.n") < F.col("all")).select(group, F.col("top.part").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / LEADERS).alias("rests"), F.ceil(F.col("all") / LEADERS).alias("blocks"))


def leftover_jobs(rows: DataFrame) -> DataFrame:
    """rows of open groups once for each job: every block of what is outside the largest part with every block of the group."""
    to = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    rest = F.pmod(F.xxhash64(F.lit("rest"), "id"), F.col("rests"))
    as_all = F.transform(to(F.col("rests")), lambda r: F.struct(r.alias("r"), own.alias("b")))
    as_rest = F.when(F.col("part") != F.col("main"), F.transform(to(F.col("blocks")), lambda b: F.struct(rest.alias("r"), b.alias("b"))))
    return rows.withColumn("job", F.explode(F.array_union(as_all, F.coalesce(as_rest, as_all))))


def candidates(signed: DataFrame) -> DataFrame:
    """Links a, b between classes (id, samples, bands) that share a bucket and are likely to be near."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
                at = np.repeat(np.arange(n), BANDS)
                band = np.tile(np.arange(BANDS, dtype=np.int64), n)
                key = (own & ~np.int64(15)) | band
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(key)], names=["id", "samples", "bucket"])

    dealt = signed.select("id", "samples", "bands").mapInArrow(deal, "id binary, samples binary, bucket bigint")
    keys = signed.select("bands").mapInArrow(keys_only, "bucket bigint").groupBy("bucket").agg(F.count("*").alias("members"))
    large = durable(keys.filter(F.col("members") > BLOCK))
    wide_ones = not large.isEmpty()
    small = dealt.join(large, "bucket", "left_anti") if wide_ones else dealt
    shares = max(1, -(-signed.count() * BANDS // SHARE))

    def within(group: pa.Table) -> pa.Table:
        """Some whole buckets."""
        bucket = group["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(starts, bucket.size))
        used = order[np.repeat(sizes > 1, sizes)]
        ids = group["id"].take(pa.array(used)).to_pylist()
        samples = np.frombuffer(b"".join(group["samples"].take(pa.array(used)).to_pylist()), np.uint8).reshape(-1, SAMPLES)
        out, at = [], 0
        for n in sizes[sizes > 1].tolist():
            out += [(ids[at + x], ids[at + y]) for x, y in forest(samples[at : at + n], range(n))]
            at += n
        return pairs_of(out)

    def across(group: pa.Table) -> pa.Table:
        samples, ids = np.frombuffer(b"".join(group["samples"].to_pylist()), np.uint8).reshape(-1, SAMPLES), group["id"].to_pylist()
        return pairs_of([(ids[x], ids[y]) for x, y in forest(samples, group["part"].to_pylist())])

    out = small.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(shares)).alias("share")).applyInArrow(within, LINKS)
    if not wide_ones:
        return out
    wide = durable(dealt.join(large, "bucket"))
    out = durable(out.unionAll(led(wide.withColumn("part", F.col("id"))).groupBy("bucket", "job").applyInArrow(across, LINKS)))
    parts = components(out).withColumnRenamed("component", "part")
    wide = durable(wide.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")))
    rest = leftover_jobs(wide.join(open_groups(wide, "bucket"), "bucket"))
    return out.unionAll(rest.groupBy("bucket", "job").applyInArrow(across, LINKS))


def pairs_of(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})


def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((own & ~np.int64(15)) | np.tile(np.arange(BANDS, dtype=np.int64), batch.num_rows))], names=["bucket"])


def verifier(shipped, threshold: float):
    """A function of a group of rows (id, samples, plain, tied): the links that exact similarity confirms between rows not tied yet."""

    def verify(group: pa.Table) -> pa.Table:
        idf = np.frombuffer(shipped.value, np.uint8)
        ids = group["id"].to_pylist()
        samples = np.frombuffer(b"".join(group["samples"].to_pylist()), np.uint8).reshape(-1, SAMPLES)
        texts, ties = group["plain"], tied_rows(group["tied"].to_pylist())
        heads = [i for i, up in enumerate(ties.up) if up == i]
        sets: dict[int, tuple] = {}

        def of(i: int) -> tuple:
            if i not in sets:
                found, times = shingles(texts[i].as_py())
                weights = np.exp(log_weights(found, times, idf))
                sets[i] = found, weights, weights.sum()
            return sets[i]

        found = [np.concatenate(x) for x in zip(*((i[i < j], j[i < j], n[i < j]) for i, j, n in agreeing(samples, samples)), strict=True)]
        order = np.argsort(-found[2].astype(np.int64), kind="stable")
        for i, j in zip(found[0][order].tolist(), found[1][order].tolist(), strict=True):
            if ties.root(i) == ties.root(j):
                continue
            (a, u, all_u), (b, v, all_v) = of(i), of(j)
            if min(all_u, all_v) < threshold * max(all_u, all_v):
                continue
            _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            both = np.minimum(u[x], v[y]).sum()
            if both >= threshold * (all_u + all_v - both) * (1 - 1e-12):
                ties.tie(i, j)
        return pairs_of([(ids[i], ids[j]) for i, j in ties.links(heads)])

    return verify


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, id, class_id, kept for every row of docs (doc_id, text); id: 128 bits of the text's words. See near_duplicates."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", plain(F.col("text")).alias("plain")).withColumn("id", identity("plain"))
    idf = frequencies(texts, max(1, docs.count()))
    shipped = spark.sparkContext.broadcast(idf.tobytes())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sampler, seen = np.frombuffer(shipped.value, np.uint8), Sampler(), set()
        for batch in batches:
            samples, keys = [], []
            for key, cell in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found, times = shingles(cell.as_py()) if key not in seen else (np.empty(0, np.uint64), None)
                if not found.size:
                    samples.append(None)
                    keys.append(None)
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)  # equal texts of a task are signed once
                s = sampler(found, log_weights(found, times, table))
                samples.append(s.astype(np.uint8).tobytes())
                keys.append(bands(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(samples, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "id", "samples", "bands"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = durable(texts.select("doc_id", "id", "plain").mapInArrow(sign, f"doc_id {kind}, id binary, samples binary, bands binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id"))
    # one row for each text: its copies meet here, and are minima before they are shuffled
    signed = durable(rows.groupBy("id").agg(F.max("samples").alias("samples"), F.max("bands").alias("bands"), first.alias("lead")))
    full = signed.filter(F.col("samples").isNotNull())
    groups = components(candidates(full))
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = attach(groups, sizes, "component").join(full.select("id", "samples", F.col("lead.doc_id").alias("doc_id")), "id")
    members = durable(members.select("id", F.col("component").alias("tied"), "component", "samples", "doc_id", "members"))
    on = texts["id"].eqNullSafe(members["id"]) & texts["doc_id"].eqNullSafe(members["doc_id"])
    whole = texts.join(members, on).select(members["id"], "component", "samples", "members", "plain").dropDuplicates(["id"])
    verify = verifier(shipped, threshold)
    jobs = led(whole).withColumn("tied", F.col("id"))
    links = durable(jobs.groupBy("component", "job").applyInArrow(verify, LINKS))
    if not members.filter(F.col("members") > 2 * LEADERS).isEmpty():
        links = links.unionAll(leftovers(texts, members, links, verify))
    found = components(links).withColumnRenamed("component", "root")
    leads = signed.select("id", "lead")
    tied = durable(leads.join(found, "id"))
    best = tied.groupBy("root").agg(F.min("lead").alias("best"))
    known = attach(tied, best, "root").select("id", "best")
    known = known.unionByName(leads.join(found, "id", "left_anti").select("id", F.col("lead").alias("best")))
    out = attach(rows.select("doc_id", "id"), known.select("id", F.col("best.doc_id").alias("class_id")), "id")
    return out.select("doc_id", "id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def leftovers(texts: DataFrame, members: DataFrame, links: DataFrame, verify) -> DataFrame:
    """Links of what leaders do not hold together in large groups: all outside a group's largest part against the whole group, in blocks."""
    parts = components(links).withColumnRenamed("component", "part")
    wide = members.filter(F.col("members") > 2 * LEADERS).join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    wide = durable(wide.select("id", "component", "samples", "doc_id", "members", "part"))
    wide = attach(wide, open_groups(wide, "component"), "component")
    on = texts["id"].eqNullSafe(wide["id"]) & texts["doc_id"].eqNullSafe(wide["doc_id"])
    wide = texts.join(wide, on).select(wide["id"], "component", "samples", "plain", "part", "main", "rests", "blocks").dropDuplicates(["id"])
    return leftover_jobs(wide).withColumn("tied", F.col("part")).groupBy("component", "job").applyInArrow(verify, LINKS)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, kept for every row of docs (doc_id, text).

    class_id: the smallest doc_id of the class. kept: this is that document. Texts are of one class if
    they have the same words in order, or if links lead from one to the other; a link is a weighted
    Jaccard similarity of `threshold` or more. Null texts count as empty; texts without
    words are all alike, of one class; a text of fewer words than a shingle is one shingle. Very long texts are
    taken whole: all their shingles are weighed, sampled and compared. Null ids come after all others. Repeated rows are copies, in
    one class. Other columns are not read; an empty table gives an empty one.
    """
    return classes(docs, threshold).drop("id")


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class, that of the smallest doc_id (null last).

    Of rows with one id and one text, that with the smallest hash of all its columns stays; of rows equal in all of them, one.
    Null and empty texts are one class; very long texts are compared whole; an empty table gives an empty one. Other columns may have any names.
    """
    i, n, d, k, h = fresh(docs, "near_id", "near_least", "near_doc", "near_key", "near_row")
    kept = classes(docs, threshold).filter("kept").select(F.col("doc_id").alias(d), F.col("id").alias(k)).distinct()
    keyed = docs.withColumn(h, row_hash(docs)).withColumn(i, identity(plain(F.col("text"))))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    both = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[d]) & (keyed[i] == kept[k]))
    both = both.groupBy(F.col(i), F.col(d)).agg(F.min_by(whole, F.col(h)).alias(n))
    return both.select(*[F.col(n).getField(c).alias(c) for c in docs.columns])
