"""Interaction parameters: geometry of pairs, bonds, angles and dihedrals, range filters, and matching to interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import keys


def _at(listed: DataFrame, sites: DataFrame, role: str, axes: str, by_frame: bool, also: list[str]) -> DataFrame:
    of = sites.select(*(["frame_id"] if by_frame else []), *also, F.col("site_id").alias(role), F.col("type_id").alias(f"type_{role}"), *[F.col(a).alias(f"{a}_{role}") for a in axes])
    return listed.join(of, ["frame_id", role] if by_frame and "frame_id" in listed.columns else role)


def bonded(listed: DataFrame, sites: DataFrame, kind: str, box: tuple | None = None, frames: bool = False) -> DataFrame:
    """The listed bonds (i, j), angles (k, j, l) or dihedrals (k, i, j, l) with type_* and the parameter p.

    Equi-joins of the topology with positions on the site (and the frame if `frames`). Missing sites drop the row. A
    box may be named by the sites' columns, for boxes that change from frame to frame; these columns are kept.
    """
    axes = "xyz"
    named = [side for side in box or () if isinstance(side, str)]
    roles = {"bond": ("i", "j"), "angle": ("k", "j", "l"), "dihedral": ("k", "i", "j", "l")}[kind]
    out = listed
    for r in roles:
        out = _at(out, sites, r, axes, frames, named if r == roles[0] else [])
    box = tuple(F.col(side) if isinstance(side, str) else side for side in box) if box else box
    at = {r: tuple(F.col(f"{a}_{r}") for a in axes) for r in roles}
    if kind == "bond":
        p = g.norm(g.displacement(at["i"], at["j"], box))
    elif kind == "angle":
        p = g.angle(g.displacement(at["j"], at["k"], box), g.displacement(at["j"], at["l"], box))
    else:
        p = g.dihedral(at["k"], at["i"], at["j"], at["l"], box)
    return out.withColumn("p", p)


def key_columns(kind: str) -> tuple:
    """Canonical type key of a bonded row, as a tuple of columns."""
    if kind == "bond":
        return keys.pair_key(F.col("type_i"), F.col("type_j"))
    if kind == "angle":
        return keys.triple_key(F.col("type_j"), F.col("type_k"), F.col("type_l"))
    return keys.quadruple_key(F.col("type_i"), F.col("type_j"), F.col("type_k"), F.col("type_l"))


def in_range(params: DataFrame, interactions: DataFrame, on: list[str], inclusive: bool = True) -> DataFrame:
    """Rows whose key is an active interaction and whose p is within [lo, hi].

    interactions: (keys, lo, hi, mode), one row for each combination of types, so bounded by the number of types. Mode
    none is inactive. Dihedrals below lo of an interaction whose `periodic` is 2 are moved up by 360 degrees first.
    """
    active = interactions.where("mode <> 'none'")
    met = params.join(active, on)
    if "periodic" in interactions.columns:
        met = met.withColumn("p", F.when((F.col("periodic") == 2) & (F.col("p") < F.col("lo")), F.col("p") + 360.0).otherwise(F.col("p")))
    return met.where((F.col("p") >= F.col("lo")) & (F.col("p") <= F.col("hi") if inclusive else F.col("p") < F.col("hi")))


def periodic_class(lo: float, hi: float) -> int:
    """0: an ordinary dihedral range; 1: the whole circle; 2: a range that passes 180 degrees."""
    return 1 if hi - lo >= 360.0 - 1e-6 else 2 if hi > 180.0 + 1e-6 or lo < -180.0 - 1e-6 else 0


def round_range(lo: float, hi: float, width: float, cutoff: float | None = None, round_upper: bool | None = None) -> tuple[float, float]:
    """A range on the bin grid: lo down, hi up. By default hi moves only for nonbonded pairs that end before the cutoff."""
    import math

    if round_upper is None:
        round_upper = cutoff is not None and abs(hi - cutoff) > 1e-6
    return math.floor(lo / width + 1e-9) * width, (math.ceil(hi / width - 1e-9) * width if round_upper else hi)


def column_offsets(interactions: DataFrame, order: list[str]) -> DataFrame:
    """Adds first_column: the sum of n_basis over the interactions before (a short table of interaction types)."""
    from pyspark.sql import Window

    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return interactions.withColumn("first_column", F.coalesce(F.sum("n_basis").over(w), F.lit(0)).cast("long"))
