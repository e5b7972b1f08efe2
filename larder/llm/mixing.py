"""Mixing sources to target weights (operator 6): Poisson replication.

A source's rate is its target share of the output over its present size. Each
document draws its number of copies from a Poisson distribution with that mean,
by inverting the distribution function at a hash of (seed, id, text): the same
row always gets the same number, on whatever executor. Documents are exploded by
their number and dealt out by a hash of the copy, then sorted by it within
each part: a random order of the whole output. Built-in functions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A source table of up to so many rows (a name and a short array each) is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000
# ... and while the distribution tables of all sources hold up to so many numbers.
BROADCAST_PLACES = 16_000_000
# Up to this mean a distribution table starts at exp(-mean), a normal number; above it at a
# tail below 1e-31, far under the hash's resolution, and is scaled to sum 1.
LARGEST_START = 700.0


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts (48 bits; any engine with md5 gives the same)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def poisson_start(mean: Column) -> Column:
    """First number of copies in the table of a mean: 0, or one that fewer copies have no chance to matter."""
    return F.when(mean > LARGEST_START, F.floor(mean - 12 * F.sqrt(mean))).otherwise(F.lit(0)).cast("int")


def poisson_table(mean: Column) -> Column:
    """Distribution function P(X <= k) for k = start, start + 1, ..., until the rest is below the hash's resolution."""
    low = poisson_start(mean)
    size = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int") - low
    first = F.when(mean > LARGEST_START, F.lit(1.0)).otherwise(F.exp(-mean))
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), size), start,
        lambda acc, k: F.struct((acc["p"] * mean / (low + k)).alias("p"),
                                F.concat(acc["cdf"], F.array(
                                    F.element_at(acc["cdf"], -1) + acc["p"] * mean / (low + k))).alias("cdf")),
        lambda acc: F.when(mean > LARGEST_START, F.transform(
            acc["cdf"], lambda c: c / F.element_at(acc["cdf"], -1))).otherwise(acc["cdf"]))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, total: float | None, source: str,
                 size: Column) -> DataFrame:
    """(source, rate): mean copies of a source's documents.

    ``weights``: source -> share (any positive scale; sources that are not
    named get 0). None: all sources that occur weigh the same. ``total``: size of the
    output; None: that of the input.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, 1.0).otherwise(0.0))
    else:
        named = docs.sparkSession.createDataFrame(
            [(str(k), float(v)) for k, v in weights.items()], "name string, weight double")
        sizes = sizes.join(named, F.col("source") == F.col("name"), "left") \
            .withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("name")
    whole = sizes.where("weight > 0").agg(F.sum("weight").alias("all_weight"))
    input_size = sizes.agg(F.sum("size").alias("all_size"))
    # One row each: scalar totals, not a join of tables.
    totals = whole.first()["all_weight"], input_size.first()["all_size"]
    if not totals[0]:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    goal = float(total if total is not None else totals[1] or 0.0)
    return sizes.select("source", F.when(
        F.col("size") > 0, goal * F.col("weight") / F.lit(totals[0]) / F.col("size")).otherwise(0.0).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None,
                seed: int = 17, source: str = "source", doc_id: str = "doc_id", text: str = "text",
                partitions: int | None = None) -> DataFrame:
    """Documents by their number of copies, in random order, with copy (0, 1, ...)
    and shuffle_key (the order).

    Sizes are characters of text; empty and null texts have size 0 and follow
    their source's rate. A null source is a source of its own. Rows equal in id
    and text draw the same number of copies each. Null ids draw by text alone.
    Extra columns pass through; ``copy`` and ``shuffle_key`` are replaced.
    """
    keep = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    size = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))
    rates = source_rates(docs, weights, total, source, size)
    spark = docs.sparkSession
    listed = rates.limit(BROADCAST_SOURCES + 1).collect()
    small = len(listed) <= BROADCAST_SOURCES and \
        sum(24 * math.sqrt(r["rate"]) + 25 for r in listed) <= BROADCAST_PLACES
    if small:  # the bounded table just collected, so that nothing is computed twice
        rates = spark.createDataFrame([(r["source"], r["rate"]) for r in listed], "source string, rate double")
    table = rates.select(F.col("source").alias("__source"), poisson_start(F.col("rate")).alias("__start"),
                         poisson_table(F.col("rate")).alias("__cdf"))
    joined = docs.join(F.broadcast(table) if small else table,
                       F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__source")))
    joined = joined.withColumn("__md5", F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    u = unit_hash(F.lit(seed), F.col(f"`{doc_id}`"), F.col("__md5"))
    copies = F.col("__start") + F.size(F.filter("__cdf", lambda c: c < F.col("__u")))
    many = joined.withColumn("__u", u).withColumn("__n", copies).where("__n > 0") \
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    key = unit_hash(F.lit(seed + 1), F.col(f"`{doc_id}`"), F.col("__md5"), F.col("copy"))
    keyed = many.select(*[F.col(f"`{c}`") for c in keep], "copy", key.alias("shuffle_key"))
    # Keys are uniform, so a hash of them deals even parts and needs no sampling pass.
    dealt = keyed.repartition(partitions, "shuffle_key") if partitions else keyed.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key")


def poisson_copies(u: float, mean: float) -> int:
    """Scalar form of the draw, for tests."""
    p = c = math.exp(-mean)
    k = 0
    while c < u:
        k += 1
        p *= mean / k
        c += p
    return k
