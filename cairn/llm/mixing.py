"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is the number of copies that each of its documents
should have on average. Whole copies are given out first. The fractions that are left are
rounded in pairs: two documents pass words between them, one way or the other at random
so that each keeps its expected share, until one of them has no fraction left. Whatever
happens, the words of a source stay the same in sum. A document that still has a fraction
meets the next one; the last one of a block goes up a tree of blocks, and only the root of
each source is rounded alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import durable, fresh, row_hash

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128
TINY = 1e-12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(by: DataFrame) -> DataFrame:
    """by with turn: the place of each source by code point, null last, from 0. Ranges of sources are numbered apart, and placed by their counts."""
    ranged = durable(by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    ranged = ranged.withColumn("within", within).join(F.broadcast(counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))), "part")
    return ranged.withColumn("turn", F.col("within") + F.col("before")).drop("part", "within", "before")


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row for each source: source, source_size, target.

    What all share is dealt out by weight; a source that gets more than most times its size stops there, and the
    rest is shared anew among the others, until none is above. Each round is one aggregate over the sources, so their number is not bounded.
    """
    by = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w", F.element_at(cycle, (F.col("turn") % len(weights) + 1).cast("int"))).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by = durable(by.select("source", "source_size", "w", "stop"))
    goal = (by.agg(F.sum("source_size")).head()[0] or 0) * float(share)
    level, stopped = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) > F.col("stop")
        now = by.agg(F.count(F.when(over, True)).alias("n"), F.coalesce(F.sum(F.when(over, F.col("stop"))), F.lit(0.0)).alias("taken"), F.sum(F.when(~over, F.col("w"))).alias("open")).head()
        if now["n"] == stopped or not now["open"]:
            break
        level, stopped = (goal - now["taken"]) / now["open"], now["n"]
    return by.select("source", "source_size", F.least(F.col("stop"), F.col("w") * F.lit(level)).alias("target"))


def chance(*of: Column) -> Column:
    """Between 0 and 1, always the same for the same values."""
    return F.pmod(F.xxhash64(F.lit("cairn mixing"), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pivot(held: Column, x: Column) -> Column:
    """held: the document met so far that has a fraction, and those decided. Of it and x, one is decided."""
    a = held["unit"]
    to_a = F.least((1 - a["f"]) * a["w"], x["f"] * x["w"])
    to_x = F.least(a["f"] * a["w"], (1 - x["f"]) * x["w"])

    up = chance(a["id"], x["id"]) * (to_a + to_x) < to_x
    after = F.when(
        up,
        F.struct((a["f"] + to_a / a["w"]).alias("a"), (x["f"] - to_a / x["w"]).alias("x"), ((1 - a["f"]) * a["w"] <= x["f"] * x["w"]).alias("first")),
    ).otherwise(
        F.struct((a["f"] - to_x / a["w"]).alias("a"), (x["f"] + to_x / x["w"]).alias("x"), (a["f"] * a["w"] <= (1 - x["f"]) * x["w"]).alias("first")),
    )

    def apply(s: Column) -> Column:
        left = F.when(s["first"], F.struct(x["id"].alias("id"), x["w"].alias("w"), s["x"].alias("f"))).otherwise(F.struct(a["id"].alias("id"), a["w"].alias("w"), s["a"].alias("f")))
        done = F.when(s["first"], F.struct(a["id"].alias("id"), (s["a"] > 0.5).alias("won"))).otherwise(F.struct(x["id"].alias("id"), (s["x"] > 0.5).alias("won")))
        return F.struct(left.alias("unit"), F.array_append(held["done"], done).alias("done"))

    # evaluated once for each pair: a one-element array is mapped
    return F.transform(F.array(after), apply)[0]


def fold(units: DataFrame, level: int) -> DataFrame:
    """Blocks of units (s, blocks, id, w, f), each folded to the units decided and the one that is left."""
    block = F.pmod(F.xxhash64(F.lit(level), "id"), F.col("blocks")).alias("block")
    listed = units.groupBy("s", block).agg(F.collect_list(F.struct(F.col("w"), F.col("id"), F.col("f"))).alias("all"))
    ordered = F.transform(F.array_sort("all"), lambda u: F.struct(u["id"].alias("id"), u["w"].alias("w"), u["f"].alias("f")))
    listed = listed.select("s", F.reverse(ordered).alias("all"))
    none = F.array_compact(F.array(F.when(F.lit(False), F.struct(F.col("all")[0]["id"].alias("id"), F.lit(False).alias("won")))))
    start = F.struct(F.col("all")[0].alias("unit"), none.alias("done"))
    return listed.select("s", F.aggregate(F.expr("slice(all, 2, size(all))"), start, pivot).alias("r")).select("s", "r.unit", "r.done")


def copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """One row for each kind of row (doc_id, source, size): source_size, target, n equal rows, and their copies: base each, one more for the first `more`.

    docs: doc_id, source, text. Size: the words of the text, 0 for null. A row that
    occurs n times is counted n times. A document without words takes none; its
    copies are still drawn. Sources: by code point, null last.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    kinds = durable(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    per = targets(kinds.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    per = durable(per.withColumn("s", F.xxhash64(F.col("source").isNull(), "source")))
    joined = kinds.withColumnRenamed("source", "of").join(per, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mass = F.col("n") * F.col("frac")
    joined = joined.withColumn("p", p).withColumn("base", F.floor("p")).withColumn("frac", F.col("p") - F.col("base"))
    joined = joined.withColumn("whole", F.floor(mass)).withColumn("f", mass - F.col("whole"))
    ident = F.struct("doc_id", "source", "size", "source_size", "target", "n", "base", "whole").alias("id")
    units = joined.select("s", ident, F.col("size").cast("double").alias("w"), "f")
    rounded = (F.col("w") > 0) & (F.col("f") > TINY) & (F.col("f") < 1 - TINY)
    alone = units.filter(~rounded).select("id", F.when(F.col("w") > 0, F.col("f") > 0.5).otherwise(chance(F.col("id")) < F.col("f")).alias("won"))
    units = units.filter(rounded)
    per_source = units.groupBy("s").agg(F.count("*").alias("units"))
    many = per_source.agg(F.max("units").alias("n")).head()["n"] or 0
    decided, level = [alone], 0
    units = units.join(per_source, "s").withColumn("blocks", F.ceil(F.col("units") / block))
    while many > 1:
        folded = durable(fold(units, level))
        decided.append(folded.select(F.explode("done").alias("d")).select("d.*"))
        many, level = -(-many // block), level + 1
        up = folded.select("s", "unit.*")
        units = up.join(up.groupBy("s").agg(F.ceil(F.count("*") / block).alias("blocks")), "s")
    decided.append(units.select("id", (chance(F.col("id"), F.lit("root")) < F.col("f")).alias("won")))
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return out.select("id.*", (F.col("id.whole") + F.col("won").cast("bigint")).alias("more"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs (doc_id, source, text).

    Nulls in any column are values of their own; a null or empty text has size 0 and takes no words; very long texts count whole; repeated rows are
    documents of their own; other columns are not read; an empty table gives an empty one.
    Reruns agree, as every draw is a hash.
    """
    each = copies(docs, **how).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    each = each.withColumn("copies", F.col("base") + (F.col("j") < F.col("more")).cast("bigint"))
    return each.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns.

    Rows of one doc_id, source and size share the copies that fall to them; the first by a hash of all columns get one more, so reruns agree. Nulls,
    empty texts (never taken more often than their copies are drawn, and of no size), very long texts (one size like any other), repeated rows
    and empty tables are as in mix(). Other columns may have any names.
    """
    kinds = copies(docs, **how)
    size, j, n, d, s, z, base, more, h = fresh(docs, "mix_size", "mix_j", "mix_copies", "mix_doc", "mix_source", "mix_of", "mix_base", "mix_more", "mix_row")
    kinds = kinds.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("base").alias(base), F.col("more").alias(more))
    sized = docs.withColumn(h, row_hash(docs)).withColumn(size, n_words(F.col("text").cast("string")))
    on = sized["doc_id"].eqNullSafe(kinds[d]) & sized["source"].cast("string").eqNullSafe(kinds[s]) & (sized[size] == kinds[z])
    both = sized.join(kinds, on)
    both = both.withColumn(j, F.row_number().over(Window.partitionBy(d, s, z).orderBy(h)) - 1)
    both = both.withColumn(n, F.col(base) + (F.col(j) < F.col(more)).cast("bigint"))
    both = both.filter(F.col(n) > 0).withColumn(j, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
