"""Mixing sources to target weights by Poisson replication.

A document of source s gets a count of copies drawn from a Poisson distribution whose mean is the source's target
repetition rate: its target share of the mixture's bytes over its share of the corpus's bytes. The draw inverts the
distribution at a uniform number hashed from the seed and the document, so it is repeatable and needs no state.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import partitions

#: A mean above this is drawn as a sum of independent draws with smaller means, so that no table grows long.
MOST_MEAN = 8.0


def uniform(*columns: Column) -> Column:
    """A double in [0, 1), from 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities 0, 1, 2, ... of a Poisson distribution of mean at most MOST_MEAN, as an array of doubles."""
    factorials = F.array(*[F.lit(float(math.factorial(k))) for k in range(60)])
    terms = F.transform(factorials, lambda f, k: F.exp(-mean) * F.pow(mean, k) / f)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    grow = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"] + x)).alias("all"))
    return F.aggregate(terms, start, grow, lambda s: s["all"])


def source_rates(docs: DataFrame, target: dict[str | None, float] | None, size: float, temperature: float) -> DataFrame:
    """(source, rate): target repetition rate by source. Sources are compared null-safe; sizes are UTF-8 bytes of text.

    `target` gives weights by source, a source that it lacks getting weight 0; without `target` a source's weight is
    its size to the power `temperature` (1: as in the corpus, 0: all alike). `size` is the mixture's size as a
    multiple of the corpus's.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("double").alias("bytes"))
    if target is None:
        weighed = sizes.withColumn("weight", F.when(F.col("bytes") > 0, F.pow("bytes", F.lit(temperature))).otherwise(0.0))
    else:
        weight = F.lit(float(target.get(None, 0.0)))
        for name, value in target.items():
            if name is not None:
                weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
        weighed = sizes.withColumn("weight", F.when(F.col("bytes") > 0, weight if None not in target else F.when(F.col("source").isNull(), float(target[None])).otherwise(weight)).otherwise(0.0))
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("bytes").alias("b"))
    row = sums.first()  # two numbers
    whole, total = float(row["w"] or 0.0), float(row["b"] or 0.0)
    rate = F.col("weight") / (whole or 1.0) * (total * size) / F.greatest("bytes", F.lit(1.0))
    return weighed.select("source", rate.alias("rate"))


def mix(docs: DataFrame, target: dict[str | None, float] | None = None, size: float = 1.0, temperature: float = 0.7, seed: int = 1, broadcast_sources: int = 20_000) -> DataFrame:
    """The mixture: all columns of `docs`, and mix_rate, mix_copies (copies drawn), mix_copy (0, 1, ...), in a global random order.

    Needs doc_id, text and source; columns named mix_rate, mix_copies or mix_copy are replaced, all others stay. A null source is a source; null ids and repeated
    rows draw by (seed, id, text) and so get the same count, each row its own copies; empty texts weigh nothing and are
    drawn at their source's rate. The rates come back by broadcast if there are no more than `broadcast_sources`
    sources, else by a join that may split hot sources. The copies are dealt by a hash of (seed, id, text, copy) and
    sorted by it within each partition.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("mix_rate", "mix_copies", "mix_copy")]
    rates = source_rates(docs, target, size, temperature)
    pieces = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int")
    own = "mixing_"  # the columns of this function alone: no column of `docs` starts with it
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    source_, rate_, pieces_, table_, hash_, deal_, key_ = (own + c for c in ("source", "rate", "pieces", "table", "hash", "deal", "key"))
    rates = rates.select(F.col("source").alias(source_), F.col("rate").alias(rate_), pieces.alias(pieces_), poisson_table(F.col("rate") / pieces).alias(table_))
    if rates.limit(broadcast_sources + 1).count() <= broadcast_sources:
        rates = F.broadcast(rates)
    text_of = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]  # a hash skips nulls
    rows = docs.select(*kept, F.xxhash64(F.lit(seed), *text_of, F.lit("copies")).alias(hash_), F.xxhash64(F.lit(seed + 1), *text_of).alias(deal_)).join(rates, F.col("source").eqNullSafe(F.col(source_)))
    draw = lambda i: F.size(F.filter(F.col(table_), lambda c: c <= uniform(F.col(hash_), i)))
    copies = F.aggregate(F.sequence(F.lit(1), F.col(pieces_)), F.lit(0), lambda s, i: s + draw(i))
    rows = rows.withColumn("mix_copies", copies).where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    rows = rows.select(*kept, F.col(rate_).alias("mix_rate"), "mix_copies", "mix_copy", F.xxhash64(deal_, "mix_copy").alias(key_))
    return rows.repartition(max(partitions(spark), 1), key_).sortWithinPartitions(key_).drop(key_)
