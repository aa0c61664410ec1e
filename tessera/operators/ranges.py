"""Ranges, histograms, radial distribution functions and Boltzmann-inverted potentials of interaction parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PI


def min_max(params: DataFrame, by: list[str], value: Column | str = "p") -> DataFrame:
    """lo, hi and n of a parameter by interaction; partial minima and maxima leave each task, so no key is hot."""
    v = F.col(value) if isinstance(value, str) else value
    return params.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n"))


def finish_ranges(found: DataFrame, defined: DataFrame, by: list[str], cutoff: float | None = None) -> DataFrame:
    """lo, hi, mode for each defined interaction: (-1, -1, none) without samples; pairs end at the cutoff."""
    out = defined.join(found, by, "left")
    none = F.col("n").isNull() if cutoff is None else F.col("n").isNull() | (F.col("lo") > cutoff)
    hi = F.col("hi") if cutoff is None else F.least(F.col("hi"), F.lit(cutoff))
    return out.select(*by, F.when(F.col("n").isNull(), -1.0).otherwise(F.col("lo")).alias("lo"), F.when(F.col("n").isNull(), -1.0).otherwise(hi).alias("hi"), F.when(none, "none").otherwise("fm").alias("mode"))


def histogram(params: DataFrame, ranges: DataFrame, by: list[str], width: float) -> DataFrame:
    """(by, bin, centre, n): counts in bins half as wide as `width`, from lo on; bins without samples have 0.

    There are 2 * int((hi - lo) / width + 0.5) bins; a value past the last is dropped. Counting is a partial
    aggregate, and the empty bins come from a sequence over the short table of ranges.
    """
    half = width / 2
    sized = ranges.where("n > 0").select(*by, "lo", (2 * F.floor((F.col("hi") - F.col("lo")) / width + 0.5)).cast("int").alias("bins"))
    at = F.floor((F.col("p") - F.col("lo") + 1e-6) / half).cast("int")
    counts = params.join(sized, by).withColumn("bin", at).where("bin < bins").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    every = sized.where("bins > 0").select(*by, "lo", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + (F.col("bin") + 0.5) * half).alias("centre"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pair_numbers(sites: DataFrame) -> DataFrame:
    """(t1, t2, pairs): how many unordered pairs of sites the types of one frame make (a short table of types)."""
    first = sites.agg(F.min("frame_id")).first()[0]
    n = sites.where(F.col("frame_id") == F.lit(first)).groupBy("type_id").agg(F.count("*").cast("double").alias("n"))
    listed = n.agg(F.collect_list(F.struct("type_id", "n")).alias("all")).select("all", F.explode("all").alias("a"))
    both = listed.select("a", F.explode(F.filter("all", lambda b: b["type_id"] >= F.col("a.type_id"))).alias("b"))
    same = F.col("a.type_id") == F.col("b.type_id")
    return both.select(F.col("a.type_id").alias("t1"), F.col("b.type_id").alias("t2"), F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n")).alias("pairs"))


def rdf(hist: DataFrame, numbers: DataFrame, by: list[str], width: float, volume: float, norm: float) -> DataFrame:
    """Adds g: counts over those of an ideal gas in the shell [centre - width / 2, centre]; null where samples meet no pair number."""
    inner = F.col("centre") - width / 2
    shell = 4.0 * PI * (F.pow("centre", F.lit(3.0)) - F.pow(inner, F.lit(3.0)))
    return hist.join(numbers, by).withColumn("g", F.when(F.col("n") > 0, F.col("n") * 3.0 / shell * norm * volume / F.nullif("pairs", F.lit(0.0))).otherwise(0.0)).drop("pairs")


def distribution(hist: DataFrame, norm: float) -> DataFrame:
    """Adds g of a bonded parameter: twice the counts times the normalization."""
    return hist.withColumn("g", F.col("n") * 2.0 * norm)


def boltzmann(dist: DataFrame, kt: float, empty: float = 100.0, most: float = 1000.0) -> DataFrame:
    """Adds u = -kT ln g; bins without samples take `empty`, values out of bounds `most`."""
    u = F.when(F.col("g") > 0, -kt * F.log("g")).otherwise(empty)
    return dist.withColumn("u", F.when((u > most) | (u < -most), most).otherwise(u))
