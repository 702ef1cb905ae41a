"""Mixing sources to target weights by Poisson replication.

A source with target weight w, of total weight W, and n of all N documents gets the mean
repetition rate r = (w / W) * size / n, where ``size`` is the number of documents the mixture
should have (all N unless given). Each document draws its number of copies from Poisson(r) by
inverting the distribution at a uniform number made of a hash of (seed, doc_id), so a rerun,
a lost executor or another partitioning draws the same copies. A rate over ``MAX_RATE``, as of a
rare source in a large table, is split into equal parts of at most that; the document's number is the
sum of a draw for each, which is Poisson(r) as well. Copies are then dealt to
partitions by a hash of (seed, doc_id, copy) and sorted by it within each, a global shuffle.

Sizes per source are partial aggregates. The rates, one row per source, are counted: up to
``FEW_SOURCES`` of them are broadcast, and text is shuffled once; more are joined like any table,
where adaptive execution splits a hot source.
A null source is a source of its own; a null doc_id draws as the text "null"; repeated rows
draw alike; texts, null, empty or long, don't matter; an empty table gives an empty result; other columns pass through whatever their
names, but for ``copy`` and ``shuffle_key``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Uniform numbers have 52 bits, so a distribution function over 1 - 2**-53 inverts all of them.
HEX_DIGITS = 13
MAX_RATE = 700
FEW_SOURCES = 10_000


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the columns, the same on any engine."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    bits = F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest k whose distribution function is over ``u``.

    Terms are added one by one until they no longer change the sum, well before a k that no 52-bit
    uniform number can pass, so the result is exact to rounding. ``rate`` is at most ``MAX_RATE``, where exp(-rate) is still a normal double.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
    term = lambda a, i: a["p"] * rate / i
    step = lambda a, i: F.when((a["c"] >= u) | ((i > rate) & (a["c"] + term(a, i) == a["c"])), a).otherwise(F.struct(term(a, i).alias("p"), (a["c"] + term(a, i)).alias("c"), i.alias("k")))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["k"])).otherwise(F.lit(0))


def poisson_draw(seed: int, doc_id: Column, rate: Column) -> Column:
    """A Poisson number of any rate from the hash of (seed, doc_id), and of the part's number where there are several."""
    parts = F.ceil(rate / MAX_RATE).cast("int")
    part = lambda a, i: (a + poisson_inverse(uniform(seed, F.lit("n"), doc_id, i), rate / parts)).cast("int")
    split = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), part)
    return F.when(rate <= MAX_RATE, poisson_inverse(uniform(seed, F.lit("n"), doc_id), rate)).otherwise(split)


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: int | None = None) -> tuple[DataFrame, int]:
    """(source, n, rate), and how many sources there are. Weights default to n ** power, which evens sources out; sources missing from ``weights`` get 0."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow("n", F.lit(power)))
    else:
        parts = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        n = n.withColumn("w", F.coalesce(F.element_at(F.create_map(*parts), F.col("source")), F.lit(0.0)) if parts else F.lit(0.0))
    t = n.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    size = float(size or t["n"] or 0)
    return n.select("source", "n", (F.col("w") / F.lit(t["w"]) * F.lit(size) / F.col("n") if t["w"] else F.lit(0.0)).alias("rate")), t["sources"]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 42, power: float = 0.5, size: int | None = None, partitions: int | None = None) -> DataFrame:
    """The columns of ``docs``, and ``copy`` from 0 and ``shuffle_key``; one row per copy, shuffled globally."""
    rates, sources = repetition_rates(docs, weights, power, size)
    rates = rates.select("source", "rate")
    rates = F.broadcast(rates) if sources <= FEW_SOURCES else rates
    # inner names can't clash with the caller's
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    inner = [{"doc_id": "id", "source": "src"}.get(c, f"c{k}") for k, c in enumerate(kept)]
    out = docs.select(*[docs[f"`{c}`"].alias(i) for c, i in zip(kept, inner, strict=True)])
    out = out.join(rates, F.col("src").eqNullSafe(F.col("source")))
    out = out.withColumn("n", poisson_draw(seed, F.col("id"), F.col("rate")))
    out = out.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("s"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    out = out.withColumn("shuffle_key", key).select(*inner, "copy", "shuffle_key").toDF(*kept, "copy", "shuffle_key")
    dealt = out.repartition(partitions, "shuffle_key") if partitions else out.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key")
