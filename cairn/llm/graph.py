"""Connected components of a distributed list of links, and joins that no key makes uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import durable


def attach(rows: DataFrame, per: DataFrame, key: str) -> DataFrame:
    """rows with the columns of per, which has one row for each key; rows without one go.

    per is mostly an aggregate of rows, and a key may have any share of these. It is written and read again, so both sides
    of the join are read from where they lie: a small one is broadcast by its known size, and in a join of two large ones
    adaptive execution splits the rows of a key that many have, which it cannot where the aggregate is part of the same stage.
    """
    return rows.join(durable(per), key)


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that it reaches) for every id in links (columns a, b, of one type that has an order).

    Alternating large-star and small-star steps: each id's larger neighbours are
    tied to its smallest one, then its smaller neighbours are. Links stay as many as
    ids at most after each round, rounds are about the logarithm of the widest
    component, and minima are gathered before rows are shuffled; those of the first step are written before they are joined (see attach). Null ends and
    links of an id to itself tie nothing. No list of links leaves the executors.
    """
    now = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = durable(now), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if mark["n"] == 0 or mark == before:
            break
        before = mark
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = attach(both.filter(F.col("y") > F.col("x")), least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))  # of few rows each: an id has no more centres than it had smaller neighbours
        small = large.join(lowest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct()
    return found.unionByName(roots.select("id", F.col("id").alias("component")))


def local_roots(n: int, a, b):
    """The smallest index that each of n reaches over the links a to b."""
    import numpy as np

    root = np.arange(n)
    while a.size:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root
