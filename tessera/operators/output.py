"""From fitted coefficients to tables: splines on output grids, finished by class, as rows and as the lines of table files.

Interactions of a class share a kind of basis and differ in their ranges; all are evaluated, padded, integrated and
written side by side, keyed by their types. Coefficient tables are short (types^2 times coefficients); the work is plain
joins and windows by interaction.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AXIS_EPS
from ..functions import basis
from . import tables


@dataclasses.dataclass(frozen=True)
class ClassModel:
    """How a class's interactions were fitted and are written.

    kind: nonbonded, bond, angle or dihedral. spline: linear (hat functions `width` apart) or bspline (`n_coef`
    coefficients of `order`). step: spacing of the output. cutoff: where nonbonded and bond tables end. periodic: whether
    a B-spline's last order - 1 coefficients repeat the first ones and are not among those fitted.
    """

    kind: str
    spline: str
    step: float
    cutoff: float = 0.0
    width: float = 0.0
    n_coef: int = 0
    order: int = 4
    periodic: bool = False

    def entries(self, p: Column, slope: bool = False) -> Column:
        """(idx, val) entries at p of an interaction with columns lo and hi."""
        if self.spline == "linear":
            return (basis.hat_slope if slope else basis.hat)(p, F.col("lo"), F.col("hi"), self.width)
        if self.spline == "bspline":
            return basis.bspline_between(self.n_coef, self.order, slope)(p, F.col("lo"), F.col("hi"))
        raise ValueError(f"unknown spline {self.spline!r}")


def interaction_coefficients(solution: DataFrame, specs: DataFrame, by: list[str], model: ClassModel) -> DataFrame:
    """(by, idx, c): a solution (col, x) cut at the interactions' first_column and n_basis; coefficients that the fit never saw are 0."""
    every = specs.select(*by, "first_column", F.explode(F.sequence(F.lit(0), F.col("n_basis").cast("int") - 1)).alias("idx"))
    placed = every.withColumn("col", (F.col("first_column") + F.col("idx")).cast("int")).join(solution.select(F.col("col").cast("int").alias("col"), "x"), "col", "left")
    out = placed.select(*by, "idx", F.coalesce("x", F.lit(0.0)).alias("c"))
    return tables.periodic_coefficients(out, by, model.order) if model.periodic else out


def evaluate(points: DataFrame, coefficients: DataFrame, by: list[str], model: ClassModel, at: str = "axis", slope: bool = False, name: str = "value") -> DataFrame:
    """`points` (by, lo, hi, <at>, ...) with the spline's value (or slope) of its interaction's coefficients (by, idx, c). Points are told apart by all their columns; repeated rows stay repeated."""
    keyed = points.withColumn("_n", F.monotonically_increasing_id())
    wide = keyed.withColumn("_b", F.explode(model.entries(F.col(at), slope))).withColumn("idx", F.col("_b.idx"))
    met = wide.join(coefficients, [*by, "idx"])
    return met.groupBy("_n", *points.columns).agg(F.sum(F.col("_b.val") * F.col("c")).alias(name)).drop("_n")


def force_table(specs: DataFrame, coefficients: DataFrame, by: list[str], model: ClassModel) -> DataFrame:
    """(by, axis, value): the spline on a grid from hi down in steps of model.step."""
    grid = tables.grid(specs.select(*by, "lo", "hi"), by, model.step).join(specs.select(*by, "lo", "hi"), by)
    return evaluate(grid, coefficients, by, model).select(*by, "axis", "value")


def potential_table(specs: DataFrame, coefficients: DataFrame, by: list[str], model: ClassModel) -> DataFrame:
    """(by, axis, value, u): for splines of potentials: u is the spline and value minus its slope."""
    grid = tables.grid(specs.select(*by, "lo", "hi"), by, model.step).join(specs.select(*by, "lo", "hi"), by)
    both = evaluate(evaluate(grid, coefficients, by, model, name="u"), coefficients, by, model, slope=True, name="slope")
    return both.select(*by, "axis", (-F.col("slope")).alias("value"), "u")


def finished(specs: DataFrame, coefficients: DataFrame, by: list[str], model: ClassModel, known: DataFrame | None = None) -> DataFrame:
    """(by, axis, value, u): the force table of each interaction as a simulation reads it; `known` (by, axis, value) is added to the fit first where an interaction is also tabulated."""
    made = force_table(specs, coefficients, by, model)
    if known is not None:
        more = known.select(*by, F.round("axis", 6).alias("at"), F.col("value").alias("more"))
        made = made.withColumn("at", F.round("axis", 6)).join(more, [*by, "at"], "left").select(*by, "axis", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value"))
    return tables.finish(made, by, model.kind, model.step, model.cutoff)


def coefficient_rows(specs: DataFrame, coefficients: DataFrame, by: list[str], model: ClassModel) -> DataFrame:
    """(by, idx, knot, c): coefficients with their knots: where a hat function is 1, or the mean of the order - 1 knots inside a B-spline's support."""
    met = coefficients.join(specs.select(*by, "lo", "hi"), by)
    if model.spline == "linear":
        return met.select(*by, "idx", (F.col("lo") + F.col("idx") * model.width).alias("knot"), "c")
    spans = model.n_coef - model.order + 1
    places = [F.least(F.greatest(F.col("idx") - (model.order - 1) + k, F.lit(0)), F.lit(spans)) for k in range(1, model.order)]
    mean = sum(places[1:], places[0]) / (model.order - 1)
    return met.select(*by, "idx", (F.col("lo") - AXIS_EPS + mean * (F.col("hi") - F.col("lo") + 2 * AXIS_EPS) / spans).alias("knot"), "c")


def table_lines(parts: list[tuple[DataFrame, ClassModel]], by: list[str]) -> DataFrame:
    """(kind, by, line_no, line) of all classes' finished tables. Every part has the same `by`; classes with fewer types give nulls."""
    out = None
    for table, model in parts:
        lines = tables.lammps_lines(table, by, model.kind).select(F.lit(model.kind).alias("kind"), *by, "line_no", "line")
        out = lines if out is None else out.union(lines)
    return out


def write_lines(lines: DataFrame, by: list[str], path: str) -> None:
    """Each interaction's lines as text in its own folder path/kind=.../table=<types>: one ordered file for each interaction."""
    keyed = lines.withColumn("table", F.concat_ws("_", *[F.col(c).cast("string") for c in by]))
    ordered = keyed.repartition("kind", "table").sortWithinPartitions("kind", "table", "line_no")
    ordered.select("kind", "table", F.col("line").alias("value")).write.mode("overwrite").partitionBy("kind", "table").text(path)


def replica_tables(specs: DataFrame, solutions: DataFrame, by: list[str], model: ClassModel) -> tuple[DataFrame, DataFrame]:
    """(all replicas, standard error) on the output grid, of solutions (replica, by, idx, c): rows (replica, by, axis, value) and (by, axis, value, se).

    Replica -1 is the fit of all frames; the error is over it and all replicas, and `value` is its own.
    """
    keys = ["replica", *by]
    ranges = solutions.select(*keys).distinct().join(specs.select(*by, "lo", "hi"), by)
    every = force_table(ranges, solutions, keys, model)
    w = F.count("value"), F.sum("value"), F.sum(F.col("value") * F.col("value"))
    se = F.sqrt(F.greatest(w[2] - w[1] * w[1] / w[0], F.lit(0.0))) / w[0]
    error = every.groupBy(*by, F.round("axis", 9).alias("axis")).agg(F.max(F.when(F.col("replica") == -1, F.col("value"))).alias("value"), se.alias("se"))
    return every, error

