"""Near-duplicate vectors: random hyperplanes in several tables, exact cosines, connected components.

Equal vectors are one class with a weight. Each class's signs against k hyperplanes
are its bucket in each of T tables. k follows the number of classes, so that a
bucket holds one or two thousand; T follows k, so that a pair at the threshold misses all
tables with a chance of `miss`. Buckets are dealt out in pairs of blocks, so none has
to fit in one task. A block gives sums (the links of each vector) and a
spanning forest (one link for each vector at most), never its pairs; a pair
that shares buckets in several tables counts in the first alone. A vector travels to
its T buckets as it came (4 bytes a component if it is of floats), with its signs as bits, and is normalised there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import durable, identity, small_batches
from cairn.llm.graph import attach, components, local_roots

BLOCK = 2048
PER_BUCKET = 2048
STRIP = 256


def shape(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits and tables for n vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, n / PER_BUCKET)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def signs(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """On which side of each hyperplane each vector lies."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], bits * tables))
    return (vectors @ planes) > 0


def keys(sides: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    return (sides.reshape(len(sides), tables, bits) << np.arange(bits)).sum(2).astype(np.int32)


def unit(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.reshape(rows, -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(x: np.ndarray, own: np.ndarray, weights: np.ndarray, block: np.ndarray, lo: int, hi: int, table: int, threshold: float):
    """Links of each row to others that count here, and its root over these links."""
    n = len(x)
    left, right = (np.arange(n),) * 2 if lo == hi else (np.flatnonzero(block == lo), np.flatnonzero(block == hi))
    links = np.zeros(n, np.int64)
    root = np.arange(n)
    for s in range(0, left.size, STRIP):
        mine = left[s : s + STRIP]
        i, j = np.nonzero(x[mine] @ x[right].T >= threshold)
        i, j = mine[i], right[j]
        ahead = i < j if lo == hi else np.ones(i.size, bool)
        i, j = i[ahead], j[ahead]
        if table and i.size:
            first = np.ones(i.size, bool)
            for t in range(table):
                first &= own[i, t] != own[j, t]
            i, j = i[first], j[first]
        links += np.bincount(i, weights[j], n).astype(np.int64) + np.bincount(j, weights[i], n).astype(np.int64)
        root = np.minimum(root, local_roots(n, np.concatenate((i, np.arange(n))), np.concatenate((j, root))))
    return links, local_roots(n, np.arange(n), root)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, miss: float = 0.001, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding: array of float or double).

    Links: cosine in double precision of threshold or more. A vector that is null,
    empty, all zero, or has a null or non-finite component links with nothing;
    vectors of different lengths do not link. component_id: the smallest vec_id
    that links lead to. Each row is a vector of its own, so repeated rows link with
    each other. Vectors of any length are taken whole. A null vec_id stays null, and counts as larger than any other. Other columns are not
    read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    e = F.col("e")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    short = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    raw, kind = (np.float32, "array<float>") if short else (np.float64, "array<double>")
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("e")).withColumn("cls", F.when(valid, identity("e")))
    classes = durable(rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.first("e").alias("e"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    bits, tables = shape(classes.count(), threshold, miss)

    def alike(batch: pa.RecordBatch, column: int):
        """Of a batch's vectors those of each length: their length, rows, values as they came, and sides."""
        sizes = np.diff(batch.column(column).offsets.to_numpy())
        flat = batch.column(column).flatten().to_numpy()
        ends = np.cumsum(sizes)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = flat.reshape(-1, size) if at.size == sizes.size else np.stack([flat[ends[i] - size : ends[i]] for i in at])
            yield size, at, x, signs(unit(x, at.size), bits, tables, seed + size)

    def counted(batches):
        for batch in batches:
            for size, _, _, sides in alike(batch, 0):
                cell, many = np.unique(keys(sides, bits, tables).astype(np.int64) * tables + np.arange(tables), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cell.size, size), pa.int32()), pa.array((cell % tables).astype(np.int32)), pa.array((cell // tables).astype(np.int32)), pa.array(many)], names=["dim", "t", "bucket", "n"])

    def dealt(batches):
        for batch in batches:
            for size, at, x, sides in alike(batch, 2):
                own, packed = keys(sides, bits, tables), np.packbits(sides, axis=1)
                ids, n = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))
                xs, ks = pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in packed], pa.binary())
                for t in range(tables):
                    same = [pa.array(np.full(at.size, v), pa.int32()) for v in (size, t)]
                    yield pa.RecordBatch.from_arrays([ids, n, xs, ks, *same, pa.array(own[:, t])], names=["cls", "n", "x", "own", "dim", "t", "bucket"])

    where = ["dim", "t", "bucket"]
    made = classes.select("cls", "n", "e").mapInArrow(dealt, "cls binary, n bigint, x binary, own binary, dim int, t int, bucket int")
    large = classes.select("e").mapInArrow(counted, "dim int, t int, bucket int, n bigint").groupBy(*where).agg(F.sum("n").alias("members"))
    large = durable(large.filter(F.col("members") > BLOCK).select(*where, F.ceil(F.col("members") / BLOCK).alias("blocks")))
    placed = made.join(large, where, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    placed = placed.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")

    def block(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n = group.num_rows
        links, root = np.zeros(n, np.int64), np.arange(n)
        ids = group["cls"]
        if n > 1:
            x = unit(np.frombuffer(b"".join(group["x"].to_pylist()), raw), n)
            packed = np.frombuffer(b"".join(group["own"].to_pylist()), np.uint8).reshape(n, -1)
            own = keys(np.unpackbits(packed, axis=1, count=bits * tables).astype(bool), bits, tables)
            lo, hi, t = (group[c][0].as_py() for c in ("lo", "hi", "t"))
            links, root = linked(x, own, group["n"].to_numpy(), group["block"].to_numpy(), lo, hi, t, threshold)
        out = np.flatnonzero(links)
        return pa.table({"cls": ids.take(pa.array(out)), "links": pa.array(links[out], pa.int64()), "root": ids.take(pa.array(root[out]))})

    found = durable(placed.groupBy(*where, "lo", "hi").applyInArrow(block, "cls binary, links bigint, root binary"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cls")
    known = classes.drop("e").join(links, "cls", "left").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = durable(known)
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = attach(known, least, "component").select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(known, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
