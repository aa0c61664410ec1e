"""Ordered operators on tables (key, axis, value): grids, integration, padding, trimming, wrapping, standard form.

A table is one interaction's and short (a few thousand rows); windows run by key, so many interactions run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AXIS_EPS, DEGREES_PER_RADIAN


def grid(ranges: DataFrame, by: list[str], width: float) -> DataFrame:
    """(by, axis): from hi downwards in steps of `width`, as far as lo."""
    steps = F.floor((F.col("hi") - F.col("lo")) / width + AXIS_EPS).cast("int")
    return ranges.withColumn("k", F.explode(F.sequence(F.lit(0), steps))).select(*by, (F.col("hi") - F.col("k") * width).alias("axis"))


def integrate(table: DataFrame, by: list[str]) -> DataFrame:
    """Adds u: minus the integral, by trapezoids from the last axis value back; u of the last row is 0."""
    w = Window.partitionBy(*by).orderBy("axis")
    part = 0.5 * (F.lead("axis").over(w) - F.col("axis")) * (F.col("value") + F.lead("value").over(w))
    back = Window.partitionBy(*by).orderBy(F.desc("axis")).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("part", F.coalesce(part, F.lit(0.0))).withColumn("u", F.sum("part").over(back)).drop("part")


def flip(table: DataFrame) -> DataFrame:
    return table.withColumn("value", -F.col("value"))


def standardize(table: DataFrame, by: list[str], value: str = "u") -> DataFrame:
    """Moves a potential so that its least value is 0."""
    return table.withColumn(value, F.col(value) - F.min(value).over(Window.partitionBy(*by)))


def minimum(table: DataFrame, by: list[str], value: str = "u") -> DataFrame:
    """(by, at, least): axis of the least value (the first on a tie)."""
    return table.groupBy(*by).agg(F.min_by("axis", F.struct(F.col(value), F.col("axis"))).alias("at"), F.min(value).alias("least"))


def trim(table: DataFrame, lo: float, hi: float) -> DataFrame:
    return table.where((F.col("axis") >= lo - AXIS_EPS) & (F.col("axis") <= hi + AXIS_EPS))


def pad(table: DataFrame, by: list[str], width: float, lo: float | None = None, hi: float | None = None, linear: bool = False) -> DataFrame:
    """Rows in steps of `width` down to lo and up to hi: the end values, or with `linear` their line's continuation."""
    w = Window.partitionBy(*by)
    up, down = w.orderBy("axis"), w.orderBy(F.desc("axis"))
    marked = table.withColumn("first", F.row_number().over(up) == 1).withColumn("last", F.row_number().over(down) == 1)
    marked = marked.withColumn("next", F.lead("value").over(up)).withColumn("before", F.lag("value").over(up))
    out = table.select(*by, "axis", "value")
    if lo is not None:
        n = F.floor((F.col("axis") - lo) / width + AXIS_EPS).cast("int")
        front = marked.where("first").withColumn("n", n).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        slope = F.col("next") - F.col("value") if linear else F.lit(0.0)
        out = out.union(front.select(*by, F.col("axis") - F.col("k") * width, F.col("value") - F.col("k") * slope))
    if hi is not None:
        n = F.floor((hi - F.col("axis")) / width + AXIS_EPS).cast("int")
        back = marked.where("last").withColumn("n", n).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        slope = F.col("value") - F.col("before") if linear else F.lit(0.0)
        out = out.union(back.select(*by, F.col("axis") + F.col("k") * width, F.col("value") + F.col("k") * slope))
    return out


def repair_front(table: DataFrame, by: list[str], after: int = 1) -> DataFrame:
    """Replaces the rows before the first sound one by the line through it and the next.

    Sound: the value is not negative and the next one is not larger; if there is none, the first whose next is not
    larger; else the table stays. A sound row needs `after` rows after it.
    """
    w = Window.partitionBy(*by)
    up = w.orderBy("axis")
    t = table.withColumn("k", F.row_number().over(up)).withColumn("rows", F.count("*").over(w)).withColumn("next", F.lead("value").over(up))
    falls = (F.col("next") <= F.col("value")) & (F.col("k") <= F.col("rows") - after)
    strict, loose = F.min(F.when(falls & (F.col("value") >= 0), F.col("k"))).over(w), F.min(F.when(falls, F.col("k"))).over(w)
    t = t.withColumn("start", F.coalesce(strict, loose))
    at = lambda c: F.max(F.when(F.col("k") == F.col("start"), F.col(c))).over(w)
    t = t.withColumn("v0", at("value")).withColumn("v1", at("next"))
    fixed = F.when(F.col("k") < F.col("start"), F.col("v0") - (F.col("start") - F.col("k")) * (F.col("v1") - F.col("v0"))).otherwise(F.col("value"))
    return t.select(*by, "axis", fixed.alias("value"))


def repair_back(table: DataFrame, by: list[str]) -> DataFrame:
    """The mirror image: rows after the last sound one (not positive, the one before not smaller) follow its line."""
    turned = table.select(*by, (-F.col("axis")).alias("axis"), (-F.col("value")).alias("value"))
    return repair_front(turned, by).select(*by, (-F.col("axis")).alias("axis"), (-F.col("value")).alias("value"))


def wrap_axis(table: DataFrame, by: list[str], lo: float = -180.0, hi: float = 180.0) -> DataFrame:
    """Moves rows past an end by 360 degrees, if more than one is past it. Adds moved."""
    w = Window.partitionBy(*by)
    above, below = F.col("axis") > hi + AXIS_EPS, F.col("axis") < lo + AXIS_EPS
    n_above, n_below = F.count(F.when(above, 1)).over(w), F.count(F.when(below, 1)).over(w)
    out = table.withColumn("shift", F.when(above & (n_above > 1), -360.0).when(below & (n_below > 1) & (n_above <= 1), 360.0).otherwise(0.0))
    return out.select(*by, (F.col("axis") + F.col("shift")).alias("axis"), "value", (F.col("shift") != 0).alias("moved"))


def shift_periodic(table: DataFrame, by: list[str], limit: float | Column, lo: float = -180.0, hi: float = 180.0) -> DataFrame:
    """Lowers u above `limit` by the jump between its last value and what the first row's value predicts across the boundary; a limit at `hi` changes nothing."""
    limit = F.lit(limit) if not isinstance(limit, Column) else limit
    w = Window.partitionBy(*by).orderBy("axis").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = (lambda c: F.first(c).over(w)), (lambda c: F.last(c).over(w))
    gap = first("axis") - lo + hi - last("axis")
    jump = last("u") - (first("u") - 0.5 * (first("value") + last("value")) * gap)
    return table.withColumn("jump", jump).withColumn("u", F.when((F.col("axis") > limit + AXIS_EPS) & (hi - limit > AXIS_EPS), F.col("u") - F.col("jump")).otherwise(F.col("u"))).drop("jump")


def add(left: DataFrame, right: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Values of two tables added on the axis values that both have, compared after rounding."""
    r = right.select(*by, F.round("axis", digits).alias("at"), F.col("value").alias("more"))
    return left.withColumn("at", F.round("axis", digits)).join(r, [*by, "at"]).select(*by, "axis", (F.col("value") + F.col("more")).alias("value"))


def lookup(points: DataFrame, table: DataFrame, by: list[str], lo: str, width: float) -> DataFrame:
    """Adds value: linear interpolation in a table (by, idx, v) at p, by an equi-join on the bin. The table is short."""
    at = F.greatest(F.col("p") - F.col(lo), F.lit(0.0)) / width
    placed = points.withColumn("bin", F.floor(at).cast("int")).withColumn("frac", at - F.floor(at).cast("double"))
    w = Window.partitionBy(*by).orderBy("idx")
    cells = table.select(*by, F.col("idx").alias("bin"), F.col("v").alias("v0"), F.lead("v").over(w).alias("v1"))
    return placed.join(cells, [*by, "bin"]).withColumn("value", F.col("v0") * (1 - F.col("frac")) + F.coalesce("v1", "v0") * F.col("frac")).drop("bin", "frac", "v0", "v1")


def periodic_coefficients(coefficients: DataFrame, by: list[str], order: int) -> DataFrame:
    """Coefficient rows (by, idx, c) with the first order - 1 repeated after the last, as a periodic spline needs."""
    n = F.count("*").over(Window.partitionBy(*by))
    marked = coefficients.withColumn("n", n)
    return marked.select(*by, "idx", "c").union(marked.where(F.col("idx") < order - 1).select(*by, (F.col("idx") + F.col("n")).cast("int"), "c"))


def lammps_lines(table: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, line_no, line): a table file's header and its rows (index, axis, potential, force)."""
    w = Window.partitionBy(*by)
    rows = table.withColumn("k", F.row_number().over(w.orderBy("axis")))
    body = rows.select(*by, (F.col("k") + 10).cast("int").alias("line_no"), F.format_string("%d %.6f %.6f %.6f", "k", "axis", "u", "value").alias("line"))
    head = table.groupBy(*by).agg(F.count("*").alias("n"), F.min("axis").alias("lo"), F.max("axis").alias("hi"), F.min_by("axis", F.struct("u", "axis")).alias("eq"))
    says = {"nonbonded": F.format_string("N %d R %.6f %.6f", "n", "lo", "hi"), "bond": F.format_string("N %d FP 0.0 0.0 EQ %.6f", "n", "eq"), "angle": F.format_string("N %d FP 0.0 0.0 EQ %.6f", "n", "eq"), "dihedral": F.format_string("N %d DEGREES", "n")}[kind]
    return head.select(*by, F.lit(2).alias("line_no"), says.alias("line")).union(body)


def finish(table: DataFrame, by: list[str], kind: str, width: float, cutoff: float) -> DataFrame:
    """A force table as a simulation reads it, with its potential u: repaired and padded by class, integrated, put in standard form.

    nonbonded: front repaired, from `width` to the cutoff, the last value being 0; bond: both ends continued in a line,
    down to `width` and up to the cutoff; angle: both ends continued in a line, down to `width` and short of 180, and
    then held to 0 and 180; dihedral: wrapped and trimmed to -180 .. 180, the potential made periodic where rows were
    moved, forces and potentials given per degree. Bonded potentials have minimum 0.
    """
    if kind == "nonbonded":
        t = pad(repair_front(table, by), by, width, width, None, linear=True)
        t = pad(t, by, width, None, cutoff).withColumn("value", F.when(F.col("axis") > cutoff - AXIS_EPS, 0.0).otherwise(F.col("value")))
        return integrate(t, by)
    if kind == "bond":
        t = pad(repair_back(repair_front(table, by), by), by, width, width, cutoff, linear=True)
    elif kind == "angle":
        t = pad(repair_back(repair_front(table, by), by), by, width, width, 180.0 - width, linear=True)
        t = trim(pad(t, by, width, 0.0, 180.0), 0.0, 180.0)
    elif kind == "dihedral":
        w = Window.partitionBy(*by)
        t = wrap_axis(table, by)
        stays = F.when(~F.col("moved"), F.col("axis"))  # rows moved down come from above the first of these, rows moved up from below the last
        low, high, moved = F.min(stays).over(w), F.max(stays).over(w), F.when(F.col("moved"), F.col("axis"))
        t = t.withColumn("limit", F.when(F.min(moved).over(w) < low, low).when(F.max(moved).over(w) > high, high).otherwise(180.0))
        t = integrate(trim(t.select(*by, "axis", "value", "limit"), -180.0, 180.0), by)
        t = shift_periodic(t, by, F.col("limit"))
        return standardize(t.select(*by, "axis", (F.col("value") / DEGREES_PER_RADIAN).alias("value"), (F.col("u") / DEGREES_PER_RADIAN).alias("u")), by)
    else:
        raise ValueError(f"no table form for {kind!r}")
    return standardize(integrate(t, by), by)
