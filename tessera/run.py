"""Whole runs: from a control file, a topology, ranges and a trajectory to ranges, and to fitted tables.

`find_ranges` and `match_forces` put the operators together as the settings say: frames are windowed, pairs found by cell
joins less the excluded ones, bonded parameters joined from the topology, each class's parameters sent to basis columns,
tables or both, and one augmented system solved and written out. Everything per frame stays a DataFrame plan; what is
listed on the driver is one row for each interaction of types.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Control
from .functions import basis, geometry
from .operators import dispatch, large, neighbors, normal, output, parameters, ranges, tables, topology
from .sources.files import frame_window
from .sources.model import Topology, topology_frames

#: Classes that a run fits, with their sites by role and the types of their key.
ROLES = {"nonbonded": ("i", "j"), "bond": ("i", "j"), "angle": ("k", "j", "l"), "dihedral": ("k", "i", "j", "l")}
BOX = ("lx", "ly", "lz")


def key_names(kind: str) -> list[str]:
    return [f"t{n + 1}" for n in range(len(ROLES[kind]))]


@dataclasses.dataclass
class System:
    """A trajectory with its topology: sites (frame_id, site_id, type_id, x.., fx.., lx..) and relations over sites."""

    control: Control
    sites: DataFrame
    bonds: DataFrame
    angles: DataFrame
    dihedrals: DataFrame
    exclusions: DataFrame  # (i, j); for exclusions of style 5, (id, molecule)


def load(spark: SparkSession, control: Control, top: Topology, trajectory: DataFrame) -> System:
    """The frames that the control asks for. Types come from the topology unless they are dynamic; angles and dihedrals from its bonds where a molecule's style infers them (2: angles, 3: both), else as listed."""
    control.check()
    made = topology_frames(spark, top)
    window = frame_window(trajectory, control.start_frame, control.n_frames)
    sites = window if control.dynamic_types else window.drop("type_id").join(made["sites"].select("site_id", "type_id"), "site_id")
    inferred = {style: _of_style(spark, top, made, style) for style in (2, 3)}
    angles = topology.angles(inferred[2].union(inferred[3])).union(made["angles"].select("k", "j", "l"))
    dihedrals = topology.dihedrals(inferred[3]).union(made["dihedrals"].select("k", "i", "j", "l"))
    excluded = topology.reachable(made["bonds"]) if control.exclusion_style == 5 else topology.exclusions(made["bonds"], control.exclusion_style)
    return System(control, sites, made["bonds"], angles, dihedrals, excluded)


def _of_style(spark: SparkSession, top: Topology, made: dict[str, DataFrame], style: int) -> DataFrame:
    """Bonds of the molecules of a style: those whose first site is in their stretch of site numbers (a stretch for each line of the system)."""
    start, inside = 0, F.lit(False)
    for kind, n in top.system:
        size = len(top.molecules[kind - 1].sites) * n
        if top.molecules[kind - 1].style == style:
            inside = inside | ((F.col("i") >= start) & (F.col("i") < start + size))
        start += size
    return made["bonds"].where(inside)


def class_parameters(system: System, kind: str) -> DataFrame:
    """(frame_id, roles.., t1.., p, and what its forces need) for every parameter of a class: pairs within the cutoff that are not excluded, or the listed bonds, angles or dihedrals of every frame."""
    control = system.control
    if kind == "nonbonded":
        near = neighbors.pairs(system.sites, control.nonbonded_cutoff, BOX)
        if control.exclusion_style == 5:
            near = neighbors.outside_molecules(near, system.exclusions)
        elif control.exclusion_style:
            near = neighbors.without_excluded(near, system.exclusions)
        pair = [F.least("type_id_i", "type_id_j").alias("t1"), F.greatest("type_id_i", "type_id_j").alias("t2")]
        return near.where("r2 > 0").select("frame_id", "i", "j", *pair, F.sqrt("r2").alias("p"), "r2", "dx", "dy", "dz")
    listed = {"bond": system.bonds, "angle": system.angles, "dihedral": system.dihedrals}[kind]
    rows = parameters.bonded(listed, system.sites, kind, BOX, frames=True)
    at = {r: tuple(F.col(f"{a}_{r}") for a in "xyz") for r in ROLES[kind]}
    sides = tuple(F.col(side) for side in BOX)
    key = [c.alias(name) for c, name in zip(parameters.key_columns(kind), key_names(kind), strict=True)]
    head = ["frame_id", *ROLES[kind], *key, "p"]
    if kind == "bond":
        d = geometry.displacement(at["i"], at["j"], sides)
        return rows.select(*head, (F.col("p") * F.col("p")).alias("r2"), *[x.alias(f"d{a}") for x, a in zip(d, "xyz", strict=True)]).where("r2 > 0")
    if kind == "angle":
        u, w = geometry.displacement(at["j"], at["k"], sides), geometry.displacement(at["j"], at["l"], sides)
        legs = rows.select(*head, *[x.alias(f"u{a}") for x, a in zip(u, "xyz", strict=True)], *[x.alias(f"v{a}") for x, a in zip(w, "xyz", strict=True)])
        at_k, at_l = geometry.angle_derivatives(geometry.cols("ux uy uz"), geometry.cols("vx vy vz"))
        slopes = {"k": at_k, "l": at_l}
    else:
        legs = rows.select(*head, *[c for r in ROLES[kind] for c in at[r]], *BOX)
        turned = geometry.dihedral_derivatives(*[at[r] for r in ("k", "i", "j", "l")], sides)
        at_k, at_l, at_i = (tuple(F.radians(x) for x in grad) for grad in turned)  # dihedral forces are fitted per radian, and tables made per degree
        slopes = {"k": at_k, "l": at_l, "i": at_i}
    slim = legs.select(F.inline(F.array(F.struct(*legs.columns)))).where("p is not null")  # made once, before the slopes that use each part many times
    return slim.select("frame_id", *ROLES[kind], *key_names(kind), "p", *[x.alias(f"at_{r}_{n}") for r, grad in slopes.items() for n, x in enumerate(grad)])


def find_ranges(system: System, kinds: tuple[str, ...] = tuple(ROLES)) -> dict[str, DataFrame]:
    """(t1.., lo, hi, n, mode) by class: least and greatest parameter of each interaction that was met; pairs are fitted unless they start beyond the cutoff."""
    out = {}
    for kind in kinds:
        by = key_names(kind)
        found = ranges.min_max(class_parameters(system, kind), by)
        cutoff = system.control.nonbonded_cutoff if kind == "nonbonded" else None
        out[kind] = ranges.finish_ranges(found, found.select(*by), by, cutoff).join(found.select(*by, "n"), by)
    return out


def distributions(system: System, kinds: tuple[str, ...] = tuple(ROLES)) -> dict[str, DataFrame]:
    """(t1.., bin, centre, n) by class: histograms of half the class's bin width over its ranges."""
    out = {}
    for kind in kinds:
        params = class_parameters(system, kind).select(*key_names(kind), "p")
        out[kind] = ranges.histogram(params, ranges.min_max(params, key_names(kind)), key_names(kind), getattr(system.control, f"{kind}_bin_width"))
    return out


@dataclasses.dataclass
class Interactions:
    """A class's interactions (t1.., mode, lo, hi, first_column, n_basis, round, table, table_lo, table_width) and how they are fitted."""

    kind: str
    rows: list[tuple]
    width: float
    step: float
    order: int
    linear: bool
    cutoff: float

    def frame(self, spark: SparkSession) -> DataFrame:
        types = "".join(f"{t} int, " for t in key_names(self.kind))
        return spark.createDataFrame(self.rows, f"{types}mode string, lo double, hi double, first_column int, n_basis int, round boolean, `table` array<double>, table_lo double, table_width double")

    def sizes(self) -> list[int]:
        """Different numbers of spline coefficients among the fitted interactions."""
        n = len(key_names(self.kind))
        return sorted({self._coefficients(r[n + 1], r[n + 2]) for r in self.rows if "fm" in r[n]})

    def _coefficients(self, lo: float, hi: float) -> int:
        return basis.n_basis(lo, hi, self.width, "linear" if self.linear else "bspline", self.order)

    def model(self, n_coef: int) -> output.ClassModel:
        return output.ClassModel(self.kind, "linear" if self.linear else "bspline", self.step, self.cutoff, self.width, n_coef, self.order)

    def entries(self, p: Column) -> Column:
        """(idx, val) entries at p of the joined interaction; on the whole circle columns go round."""
        if self.linear:
            made = basis.hat(p, F.col("lo"), F.col("hi"), self.width)
        else:
            made = F.array().cast(basis.ENTRY)
            for n in self.sizes():
                bins = F.floor((F.col("hi") - F.col("lo")) / self.width + 0.5)
                made = F.when(bins + (self.order - 1) == n, basis.bspline_between(n, self.order)(p, F.col("lo"), F.col("hi"))).otherwise(made)
        return F.transform(made, lambda b: F.struct(F.when(F.col("round"), F.pmod(b["idx"], F.col("n_basis"))).otherwise(b["idx"]).cast("int").alias("idx"), b["val"].alias("val")))


def plan(control: Control, listed: dict[str, list[dict]], known: list[dict] | None = None) -> tuple[dict[str, Interactions], int]:
    """(interactions by class, number of columns) from range rows (`parse_ranges`) and tables (`parse_tables`).

    Pair ranges are rounded to the bin grid; columns follow each other by class and by row. Tables are matched by class
    and types. Whole-circle dihedrals have a column less than bins (B-splines) or as many as bins (linear).
    """
    linear, column, out = control.basis_type == "linear", 0, {}
    lookup = {("nonbonded" if t["class"] == "pair" else t["class"], tuple(t["types"])): t for t in known or []}
    for kind, roles in ROLES.items():
        rows = []
        width, order = getattr(control, f"{kind}_bin_width"), getattr(control, f"{kind}_order")
        made = Interactions(kind, rows, width, getattr(control, f"{kind}_output_width"), order, linear, control.nonbonded_cutoff)
        for given in listed.get(kind, []):
            types, mode, lo, hi = tuple(given["types"]), given["mode"], given["lo"], given["hi"]
            key = types if kind == "dihedral" else (types[0], *sorted(types[1:])) if kind == "angle" else tuple(sorted(types))
            table = lookup.get((kind, types)) or lookup.get((kind, key))
            if "tab" in mode and table is None:
                raise ValueError(f"no table for {kind} {types}")
            n = 0
            whole = kind == "dihedral" and parameters.periodic_class(lo, hi) == 1
            if mode != "none":
                lo, hi = parameters.round_range(lo, hi, width, control.nonbonded_cutoff if kind == "nonbonded" else None)
            if "fm" in mode:
                bins = int((hi - lo) / width + 0.5)
                if bins < 1:
                    raise ValueError(f"the range of {kind} {types} is shorter than a bin")
                n = (bins if linear else bins - 1) if whole else made._coefficients(lo, hi)
            held = (table["values"], table["lo"], table["binwidth"]) if "tab" in mode else (None, 0.0, 1.0)
            rows.append((*key, mode, float(lo), float(hi), column, n, whole, *held))
            column += n
        if rows:
            if len(roles) == 4:  # dihedral keys as the parameters have them
                rows[:] = [(*_quadruple(r[:4]), *r[4:]) for r in rows]
            out[kind] = made
    if len({(kind, r[: len(ROLES[kind])]) for kind, m in out.items() for r in m.rows}) < sum(len(m.rows) for m in out.values()):
        raise ValueError("an interaction is given twice")
    return out, column


def _quadruple(types: tuple[int, ...]) -> tuple[int, ...]:
    """Types (i, j, k, l) of the central and the end sites of a dihedral in their canonical order."""
    i, j, k, end = types
    return (j, i, end, k) if i > j or (i == j and k > end) else (i, j, k, end)


def system_rows(spark: SparkSession, system: System, interactions: dict[str, Interactions], n_columns: int, virials: DataFrame | None = None, virial_weight: float = 1.0) -> DataFrame:
    """All rows of [A f] (frame_id, site_id, dim, col, v): forces of every class by its modes, targets, and virial rows where `virials` (frame_id, virial) are given."""
    made, virial = None, None
    for kind, own in interactions.items():
        met = dispatch.with_interactions(class_parameters(system, kind), own.frame(spark), key_names(kind))
        if kind in ("nonbonded", "bond"):
            forces = dispatch.pair_terms(met, own.entries, n_columns)
            more = dispatch.virial_terms(met, own.entries, n_columns) if virials is not None else None
            virial = more if virial is None else virial.union(more) if more is not None else virial
        else:
            slopes = {r: tuple(F.col(f"at_{r}_{n}") for n in range(3)) for r in (("k", "l") if kind == "angle" else ("k", "l", "i"))}
            wide = met.withColumn("terms", dispatch.terms(F.col("p"), own.entries, n_columns))
            listed = F.transform("terms", lambda t: F.struct(t["col"].alias("idx"), t["val"].alias("val")))
            forces = normal.site_entries(wide, listed, slopes, "j")
        forces = forces.select("frame_id", "site_id", "dim", "col", "v")
        made = forces if made is None else made.union(forces)
    if made is None:
        raise ValueError("no interaction is fitted or tabulated")
    return dispatch.system(made, normal.targets(system.sites), n_columns, virial if virials is not None else None, virials, virial_weight)


@dataclasses.dataclass
class Fit:
    interactions: dict[str, Interactions]
    n_columns: int
    triangle: DataFrame
    solution: DataFrame


def match_forces(spark: SparkSession, system: System, interactions: dict[str, Interactions], n_columns: int, weights: DataFrame | None = None, virials: DataFrame | None = None, virial_weight: float = 1.0) -> Fit:
    """The normal equations of all frames (with `weights`: frame_id, weight) and their solution (col, x), regularised as the control says."""
    control = system.control
    rows = system_rows(spark, system, interactions, n_columns, virials if control.virial_constraint else None, virial_weight)
    triangle = normal.gram_rows(rows, n_columns, weights if control.use_frame_weights else None)
    path = f"{large.shared_folder(spark)}/equations"
    triangle.write.parquet(path)  # read by the solver more than once
    triangle = spark.read.schema(triangle.schema).parquet(path)
    ridge = control.tikhonov_parameter if control.regularization_style == 1 else 0.0
    return Fit(interactions, n_columns, triangle, large.solution(triangle, n_columns, ridge, rcond=control.rcond))


def fitted_tables(spark: SparkSession, fit: Fit) -> dict[str, DataFrame]:
    """(t1.., axis, value, u) by class: fitted forces, and tabulated ones where an interaction has both, as a simulation reads them."""
    out: dict[str, DataFrame] = {}
    for kind, own in fit.interactions.items():
        by = key_names(kind)
        fitted = own.frame(spark).where(dispatch.fits(F.col("mode")))
        bins = F.floor((F.col("hi") - F.col("lo")) / own.width + 0.5).cast("int")
        fitted = fitted.withColumn("n_coef", bins + (1 if own.linear else own.order - 1))
        known = fitted.where(dispatch.tabulated(F.col("mode")))
        grid = tables.grid(known.select(*by, "lo", "hi"), by, own.step).join(known, by)
        known = grid.select(*by, "axis", dispatch.table_force(F.col("axis"), F.col("table"), F.col("table_lo"), F.col("table_width")).alias("value"))
        for n in own.sizes():
            some = fitted.where(F.col("n_coef") == n)
            every = some.select(*by, "first_column", "n_basis", F.explode(F.sequence(F.lit(0), F.col("n_coef") - 1)).alias("idx"))
            col = (F.col("first_column") + F.pmod(F.col("idx"), F.col("n_basis"))).cast("int")  # on the whole circle the first coefficients come again
            c = every.withColumn("col", col).join(fit.solution, "col", "left").select(*by, "idx", F.coalesce("x", F.lit(0.0)).alias("c"))
            done = output.finished(some.select(*by, "lo", "hi"), c, by, own.model(n), known)
            out[kind] = done if kind not in out else out[kind].union(done)
    return out


def fitted_lines(spark: SparkSession, fit: Fit) -> DataFrame:
    """(kind, types, line_no, line): every fitted interaction's table file."""
    out = None
    for kind, table in fitted_tables(spark, fit).items():
        by = key_names(kind)
        lines = tables.lammps_lines(table, by, kind).select(F.lit(kind).alias("kind"), F.concat_ws("_", *[F.col(t).cast("string") for t in by]).alias("types"), "line_no", "line")
        out = lines if out is None else out.union(lines)
    return out


def residual(fit: Fit) -> float:
    """Sum of squares that the fit leaves: x'Gx - 2x'r + f'f, with partial sums on executors."""
    x = fit.solution.select(F.col("col").alias("i"), "x")
    return max(0.0, normal.residual(fit.triangle, x, fit.n_columns).first()[0] or 0.0) if fit.n_columns else math.nan
