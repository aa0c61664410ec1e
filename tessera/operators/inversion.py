"""Boltzmann-inverted distributions fitted by splines: one small least-squares problem for each interaction, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import solve


def design(bins: DataFrame, by: list[str], basis: Callable[[Column], Column], at: str = "centre", value: str = "u") -> DataFrame:
    """(by, bin, col, v): rows of each interaction's design matrix, the potential being column -1."""
    own = bins.withColumn("b", F.explode(basis(F.col(at)))).select(*by, "bin", F.col("b.idx").alias("col"), F.col("b.val").alias("v"))
    return own.union(bins.select(*by, "bin", F.lit(-1).alias("col"), F.col(value).alias("v")))


def equations(rows: DataFrame, by: list[str], n_columns: int) -> DataFrame:
    """(by, i, j, v), i <= j: augmented normal equations of each interaction, the potential being column n_columns. A row has few entries, so its products are few."""
    r = rows.select(*by, "bin", F.when(F.col("col") < 0, n_columns).otherwise(F.col("col")).alias("i"), "v").groupBy(*by, "bin", "i").agg(F.sum("v").alias("v"))
    packed = r.groupBy(*by, "bin").agg(F.collect_list(F.struct("i", "v")).alias("e"))  # a row's own entries: the spline's order and one
    both = packed.select(*by, "e", F.explode("e").alias("a")).select(*by, "a", F.explode("e").alias("b")).where("a.i <= b.i")
    return both.groupBy(*by, F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def fit(bins: DataFrame, by: list[str], basis: Callable[[Column], Column], n_columns: int, rcond: float = -1.0) -> DataFrame:
    """(by, idx, c): coefficients of the spline through each interaction's potentials (by, bin, centre, u).

    Least squares of minimum norm, so that splines without bins in their support, or an interaction with fewer bins than
    coefficients, are defined. Groups hold n_columns^2 numbers.
    """
    got = solve.by_group(equations(design(bins, by, basis), by, n_columns), n_columns, by, rcond=rcond)
    return got.select(*by, F.col("col").alias("idx"), F.col("x").alias("c"))


def screened(interactions: DataFrame, classes: list[str]) -> DataFrame:
    """Interactions (class, ..., mode, n_basis) as inversion sees them: classes without a distribution are neither fitted nor tabulated and have no columns."""
    inverted = F.col("class").isin(*classes) if classes else F.lit(False)
    return interactions.withColumn("mode", F.when(inverted, F.col("mode")).otherwise("none")).withColumn("n_basis", F.when(inverted, F.col("n_basis")).otherwise(0))
