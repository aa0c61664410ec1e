"""Interactions by mode: fitted, tabulated, both or neither, from one pass over their parameters.

Every row of the augmented system [A f] is an entry; the target is the column after the last coefficient. A parameter of a
fitted interaction gives basis entries in its own columns; one of a tabulated interaction takes its table's force from the
target column; one of a mixed interaction does both. So one relation, one shuffle and one product serve all modes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normal

MODES = ("none", "fm", "tab", "fm+tab", "tab+fm")
TERM = "array<struct<col:int,val:double>>"


def fits(mode: Column) -> Column:
    return mode.isin("fm", "fm+tab", "tab+fm")


def tabulated(mode: Column) -> Column:
    return mode.isin("tab", "fm+tab", "tab+fm")


def table_force(p: Column, values: Column, lo: Column, width: Column) -> Column:
    """Linear interpolation in a table held as an array, its first value at `lo`; the ends continue flat."""
    at = F.least(F.greatest((p - lo) / width, F.lit(0.0)), (F.size(values) - 1).cast("double"))
    k = F.least(F.floor(at).cast("int"), F.size(values) - 2)
    f = at - k
    return F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.element_at(values, k + 1) * (1 - f) + F.element_at(values, k + 2) * f)


def terms(p: Column, basis: Callable[[Column], Column], n_columns: int) -> Column:
    """What a parameter puts into columns: (first_column + idx, basis value) if it is fitted, (n_columns, -table force) if tabulated.

    Uses the columns mode, first_column, table, table_lo and table_width of the joined interactions.
    """
    own = F.transform(basis(p), lambda b: F.struct((F.col("first_column") + b["idx"]).cast("int").alias("col"), b["val"].alias("val")))
    known = F.array(F.struct(F.lit(n_columns).alias("col"), (-table_force(p, F.col("table"), F.col("table_lo"), F.col("table_width"))).alias("val")))
    empty = F.array().cast(TERM)
    return F.concat(F.when(fits(F.col("mode")), own.cast(TERM)).otherwise(empty), F.when(tabulated(F.col("mode")), known.cast(TERM)).otherwise(empty))


def with_interactions(params: DataFrame, interactions: DataFrame, on: list[str], p: str = "p") -> DataFrame:
    """Rows whose types are an active interaction and whose parameter is within its range, with the interaction's columns.

    interactions: (on..., mode, lo, hi, first_column, table array<double>, table_lo, table_width), one row for each
    combination of types. A table is null for interactions without one; an unknown mode is an error.
    """
    known = F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise(F.raise_error(F.concat(F.lit("unknown mode "), F.col("mode"))))
    active = interactions.withColumn("mode", known).where("mode <> 'none'")
    return params.join(active, on).where((F.col(p) >= F.col("lo")) & (F.col(p) <= F.col("hi")))


def pair_terms(pairs: DataFrame, basis: Callable[[Column], Column], n_columns: int, dims: str = "xyz") -> DataFrame:
    """Entries (frame_id, site_id, dim, col, v) of pairs (i, j, r2, d*, p and the interaction's columns): -term * d / r on i, the opposite on j."""
    r = F.sqrt("r2")
    ends = [F.struct(F.col(site).alias("site_id"), F.lit(n).alias("dim"), (s * F.col(f"d{a}") / r).alias("part")) for site, s in (("i", -1.0), ("j", 1.0)) for n, a in enumerate(dims)]
    wide = pairs.withColumn("t", F.explode(terms(F.col("p"), basis, n_columns))).withColumn("h", F.explode(F.array(*ends)))
    return wide.select("frame_id", "h.site_id", "h.dim", "t.col", (F.col("t.val") * F.col("h.part")).alias("v"))


def virial_terms(pairs: DataFrame, basis: Callable[[Column], Column], n_columns: int) -> DataFrame:
    """(frame_id, col, v): the same terms times r, summed over a frame's pairs: basis sums, and minus the tables' virial in the target column."""
    wide = pairs.withColumn("t", F.explode(terms(F.col("p"), basis, n_columns)))
    return wide.groupBy("frame_id", "t.col").agg(F.sum(F.col("t.val") * F.sqrt("r2")).alias("v"))


def system(entries: DataFrame, target: DataFrame, n_columns: int, virial: DataFrame | None = None, virial_target: DataFrame | None = None, virial_weight: float = 1.0) -> DataFrame:
    """All rows of [A f] as entries (frame_id, site_id, dim, col, v), duplicates summed: one row for each force component and, with `virial`, one for each frame.

    Frame rows have site_id -1; `virial_target` (frame_id, virial) is their target. They weigh `virial_weight` times a
    force component.
    """
    cells = ["frame_id", "site_id", "dim", "col", "v"]
    both = entries.select(*cells).union(target.select("frame_id", "site_id", "dim", F.lit(n_columns).alias("col"), F.col("f").alias("v")))
    if virial is not None:
        scale = F.lit(float(virial_weight) ** 0.5)
        row = [F.lit(-1).cast("long").alias("site_id"), F.lit(0).alias("dim")]
        both = both.union(virial.select("frame_id", *row, "col", (F.col("v") * scale).alias("v")))
        if virial_target is not None:
            both = both.union(virial_target.select("frame_id", *row, F.lit(n_columns).alias("col"), (F.col("virial") * scale).alias("v")))
    return normal.collected(both)
