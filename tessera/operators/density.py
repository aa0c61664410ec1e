"""Forces of local-density interactions: what a site feels through its own density and through its neighbours'.

A site's density of a group pair is a sum of kernels over its neighbours; an interaction acts at that density, through the
kernel's slope, along each neighbour's direction, on both ends. Densities and entries come from one neighbour join: the
pairs are dealt once by (frame, home site, groups), and a window over each site's neighbours gives its density beside
them. A site's neighbours are bounded by the cutoff's volume, so no window grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels

OWN = ["frame_id", "i", "home", "other"]


def with_densities(near: DataFrame, kind: str, cutoff: float, **spec: float) -> DataFrame:
    """`near` (of neighbors.density_pairs) with each neighbour's share `w` of its home site's density, and that `density`.

    Shares are the group's weight times the kernel. Sites without neighbours have no rows (and no forces).
    """
    shared = near.withColumn("w", F.col("weight") * kernels.kernel(kind, F.sqrt("r2"), cutoff, **spec))
    return shared.withColumn("density", F.sum("w").over(Window.partitionBy(*OWN)))


def density_entries(near: DataFrame, kind: str, cutoff: float, basis: Callable[[Column], Column], first_column: Column | int = 0, dims: str = "xyz", consistent: bool = False, **spec: float) -> DataFrame:
    """Entries (frame_id, site_id, dim, col, v) of neighbours: -phi(density) w'(r) d / r on the home site and the opposite on the neighbour.

    phi are the basis functions at the home site's density, w' the kernel's slope times the group's weight, and d runs
    from home to neighbour. `first_column` may depend on home and other. Pairs at no distance have no direction and go.
    """
    lit = F.lit(first_column) if isinstance(first_column, int) else first_column
    r = F.sqrt("r2")
    rows = with_densities(near, kind, cutoff, **spec).where("r2 > 0")
    pull = F.col("weight") * kernels.kernel_slope(kind, r, cutoff, consistent=consistent, **spec) / r
    ends = [F.struct(F.col(site).alias("site_id"), F.lit(n).alias("dim"), (s * F.col(f"d{a}") * F.col("pull")).alias("part")) for site, s in (("i", -1.0), ("j", 1.0)) for n, a in enumerate(dims)]
    wide = rows.withColumn("base", lit).withColumn("pull", pull).withColumn("b", F.explode(basis(F.col("density")))).withColumn("h", F.explode(F.array(*ends)))
    return wide.select("frame_id", "h.site_id", "h.dim", (F.col("base") + F.col("b.idx")).cast("int").alias("col"), (F.col("b.val") * F.col("h.part")).alias("v"))


def density_virial(near: DataFrame, kind: str, cutoff: float, basis: Callable[[Column], Column], first_column: Column | int = 0, consistent: bool = False, **spec: float) -> DataFrame:
    """(frame_id, col, v): sum over neighbours of phi(density) w'(r) r, the density interactions' part of a frame's virial row."""
    lit = F.lit(first_column) if isinstance(first_column, int) else first_column
    r = F.sqrt("r2")
    rows = with_densities(near, kind, cutoff, **spec).withColumn("pull", F.col("weight") * kernels.kernel_slope(kind, r, cutoff, consistent=consistent, **spec) * r)
    wide = rows.withColumn("base", lit).withColumn("b", F.explode(basis(F.col("density"))))
    return wide.groupBy("frame_id", (F.col("base") + F.col("b.idx")).cast("int").alias("col")).agg(F.sum(F.col("b.val") * F.col("pull")).alias("v"))
