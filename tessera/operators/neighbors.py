"""Neighbour joins of sites in periodic boxes: equi-joins on (frame, cell), never a product of sites.

A frame's cells are at least a cutoff wide. With fewer than three cells on an axis, neighbouring offsets would name one
cell twice; that axis then takes one cell, which joins everything along it, and the distance filter does the rest.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import displacement, dot

AXES = "xyz"
#: Parts that the left sites of a frame without cells are dealt in, and copies of its right sites: fewer than the 14 of cells.
LONE_PARTS = 8


def cell_counts(box: tuple[float, ...], cutoff: float) -> list[int]:
    """Cells per axis; a cutoff over half a box has no unique nearest image."""
    if any(cutoff > side / 2 for side in box):
        raise ValueError("the cutoff is more than half the box")
    counts = [int(side / cutoff) for side in box]
    return [n if n >= 3 else 1 for n in counts]


def cell(x: Column, side: float, n: int) -> Column:
    """Number of the cell of x in [0, side)."""
    return F.least(F.greatest(F.floor(x / (side / n)), F.lit(0)), F.lit(n - 1)).cast("int")


def offsets(counts: list[int], half: bool) -> list[tuple[int, ...]]:
    """Stencil of neighbouring cells. half: the own cell, and of each opposite pair of offsets the one whose first non-zero step is +1."""
    every = list(product(*[(-1, 0, 1) if n >= 3 else (0,) for n in counts]))
    return [o for o in every if not half or next((s for s in o if s), 0) >= 0]


def with_cells(sites: DataFrame, box: tuple[float, ...], counts: list[int]) -> DataFrame:
    number = F.lit(0)
    for a, side, n in zip(AXES, box, counts, strict=False):
        number = number * n + cell(F.col(a), side, n)
    return sites.withColumn("cell", number)


def pairs(sites: DataFrame, cutoff: float, box: tuple[float | str, ...], extra: tuple[str, ...] = ("type_id",), directed: bool = False) -> DataFrame:
    """(frame_id, i, j, <extra>_i, <extra>_j, r2, dx, dy, dz): neighbours with r <= cutoff, d from i to j by nearest image.

    `box` has a side for each axis: a number, or the name of a column for boxes that change from frame to frame. Each
    unordered pair once, i < j; `directed` gives both orders. Sites must be wrapped into the box. The left side is copied
    to its half stencil (14 cells of 27), so one equi-join on (frame, cell) finds all candidates; the squared distance is
    filtered before any root. Skewed cells are split by adaptive execution. Extra columns are carried. A cutoff over half
    a box has no unique nearest image and is an error.
    """
    dim = len(box)
    axes = AXES[:dim]
    named = any(isinstance(side, str) for side in box)
    if named:
        sides = [F.col(side) if isinstance(side, str) else F.lit(float(side)) for side in box]
        sites = sites.select("frame_id", "site_id", *extra, *axes, *[side.cast("double").alias(f"side_{a}") for a, side in zip(axes, sides, strict=True)])
        wide = [f"side_{a}" for a in axes]
        sides = [F.col(c) for c in wide]
        fits = (F.least(*sides) if dim > 1 else sides[0]) / 2 >= cutoff
        counts = [F.when(F.floor(side / cutoff) >= 3, F.floor(side / cutoff)).otherwise(1).cast("int") for side in sides]
        counts[0] = F.when(fits, counts[0]).otherwise(F.raise_error(F.lit("the cutoff is more than half the box")).cast("int"))
        every = [o for o in product((-1, 0, 1), repeat=dim) if next((x for x in o if x), 0) >= 0]
    else:
        wide, sides = [], list(box)
        counts = cell_counts(box, cutoff)
        every = offsets(counts, half=True)
    celled = with_cells(sites.select("frame_id", "site_id", *extra, *axes, *wide), tuple(sides), counts)
    steps = []
    for o in every:
        number = F.lit(0)
        for a, side, n, s in zip(axes, sides, counts, o, strict=True):
            number = number * n + F.pmod(cell(F.col(a), side, n) + s, n if named else F.lit(n))
        used = F.lit(True)
        for n, s in zip(counts, o, strict=True):
            used = used & (n >= 3) if named and s else used
        steps.append(F.struct(number.alias("to"), F.lit(not any(o)).alias("own"), used.alias("used")))
    stencil = F.filter(F.array(*steps), lambda step: step["used"]) if named else F.array(*steps)
    left = celled.select("frame_id", F.col("site_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in (*extra, *axes)], *wide, F.explode(stencil).alias("step"))
    left = left.select("*", F.col("step.to").alias("cell"), F.col("step.own").alias("own")).drop("step")
    right = celled.select(F.col("frame_id").alias("frame_b"), F.col("cell").alias("cell_b"), F.col("site_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in (*extra, *axes)])
    if not named and len(every) == 1:  # one cell: a frame would be one key, and the work of one task
        left = left.withColumn("cell", F.pmod(F.hash("a"), F.lit(LONE_PARTS)))
        right = right.withColumn("cell_b", F.explode(F.array(*[F.lit(k) for k in range(LONE_PARTS)])))
    d = displacement(tuple(F.col(f"{c}_a") for c in axes), tuple(F.col(f"{c}_b") for c in axes), tuple(sides))
    met = left.join(right, (F.col("frame_id") == F.col("frame_b")) & (F.col("cell") == F.col("cell_b")) & (~F.col("own") | (F.col("a") < F.col("b"))))
    met = met.withColumn("r2", dot(d, d)).where(F.col("r2") <= cutoff * cutoff)
    flip = F.col("a") > F.col("b")
    one = lambda first: [F.when(flip, F.col(f"{c}_{'b' if first else 'a'}")).otherwise(F.col(f"{c}_{'a' if first else 'b'}")).alias(f"{c}_{'i' if first else 'j'}") for c in extra]
    ordered = met.select("frame_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), *one(True), *one(False), "r2", *[F.when(flip, -x).otherwise(x).alias(f"d{c}") for c, x in zip(axes, d, strict=True)])
    if not directed:
        return ordered
    turned = {"i": "j", "j": "i", **{f"{c}_i": f"{c}_j" for c in extra}, **{f"{c}_j": f"{c}_i" for c in extra}}
    here = F.struct(*ordered.columns)
    there = F.struct(*[(-F.col(n) if n in [f"d{a}" for a in axes] else F.col(turned.get(n, n))).alias(n) for n in ordered.columns])
    return ordered.select(F.explode(F.array(here, there)).alias("p")).select("p.*")  # both orders from one pass


def without_excluded(pairs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Pairs whose sites no bond path excludes. exclusions: (i, j) with i < j."""
    low, high = F.least(pairs["i"], pairs["j"]), F.greatest(pairs["i"], pairs["j"])
    out = exclusions.select(F.col("i").alias("ex_i"), F.col("j").alias("ex_j"))
    return pairs.join(out, (low == out["ex_i"]) & (high == out["ex_j"]), "left_anti")


def pairs_outside(sites: DataFrame, cutoff: float, box: tuple[float | str, ...], exclusions: DataFrame, extra: tuple[str, ...] = ("type_id",)) -> DataFrame:
    """`pairs` (i < j) less the exclusions (i, j), i < j, which go with their first site: sites are joined to them, pairs are not shuffled.

    A site's excluded partners are one array, so they are to be few, as those of a few bonds are.
    """
    partners = exclusions.groupBy(F.col("i").alias("ex_site")).agg(F.collect_set("j").alias("excluded"))
    held = sites.join(partners, F.col("site_id") == F.col("ex_site"), "left")
    near = pairs(held, cutoff, box, (*extra, "excluded"))
    return near.where(F.col("excluded_i").isNull() | ~F.array_contains("excluded_i", F.col("j"))).drop("excluded_i", "excluded_j")


def outside_molecules(pairs: DataFrame, molecules: DataFrame) -> DataFrame:
    """Pairs whose sites no path of bonds of any length joins. molecules: (id, molecule) of bonded sites (`topology.reachable`).

    Two joins on the site; the pairs within molecules, which grow as the square of a molecule, are never made.
    """
    here = molecules.select(F.col("id").alias("at_i"), F.col("molecule").alias("own_i"))
    there = molecules.select(F.col("id").alias("at_j"), F.col("molecule").alias("own_j"))
    met = pairs.join(here, pairs["i"] == here["at_i"], "left").join(there, pairs["j"] == there["at_j"], "left")
    return met.where(F.col("own_i").isNull() | F.col("own_j").isNull() | (F.col("own_i") != F.col("own_j"))).select(*pairs.columns)


def triples(sites: DataFrame, cutoff: float, box: tuple[float | str, ...], exclusions: DataFrame | None = None) -> DataFrame:
    """(frame_id, centre, k, l, types, leg vectors u and v): each centre with each unordered pair of its neighbours, k < l.

    A self-join of the directed neighbour list on (frame, centre); both legs must be within the cutoff and not excluded.
    Boxes may change from frame to frame, as in `pairs`.
    """
    near = pairs(sites, cutoff, box, directed=True)
    near = near if exclusions is None else without_excluded(near, exclusions)
    axes = AXES[: len(box)]
    u = near.select("frame_id", F.col("i").alias("centre"), F.col("type_id_i").alias("type_c"), F.col("j").alias("k"), F.col("type_id_j").alias("type_k"), *[F.col(f"d{a}").alias(f"u{a}") for a in axes])
    v = near.select(F.col("frame_id").alias("frame_v"), F.col("i").alias("centre_v"), F.col("j").alias("l"), F.col("type_id_j").alias("type_l"), *[F.col(f"d{a}").alias(f"v{a}") for a in axes])
    return u.join(v, (F.col("frame_id") == F.col("frame_v")) & (F.col("centre") == F.col("centre_v")) & (F.col("k") < F.col("l"))).drop("frame_v", "centre_v")


def density_pairs(sites: DataFrame, groups: DataFrame, cutoff: float, box: tuple[float | str, ...], exclusions: DataFrame | None = None) -> DataFrame:
    """(frame_id, i, j, home, other, weight, r2, d*): ordered neighbours fanned out by the groups of both types, r < cutoff.

    groups: (group_id, type_id, weight), a relation over types, so bounded by groups x types.
    """
    near = pairs(sites, cutoff, box, directed=True).where(F.col("r2") < cutoff * cutoff)
    near = near if exclusions is None else without_excluded(near, exclusions)
    home = groups.select(F.col("group_id").alias("home"), F.col("type_id").alias("type_id_i"))
    other = groups.select(F.col("group_id").alias("other"), F.col("type_id").alias("type_id_j"), "weight")
    return near.join(home, "type_id_i").join(other, "type_id_j")
