"""Queries of whole models: density, angle and dihedral entries, modes, virial rows, large and grouped solves, tables from fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import basis
from ..functions import geometry as g
from ..operators import density, dispatch, inversion, large, neighbors, normal, output, ranges, solve
from ..sources import views as v
from .fitting import _G, BASES, COLUMNS, CUTOFF, FIT, S2, TYPES, entries, target, weights
from .geometry import ANG, ANGLE_LEGS, ANGLES, BOTH, CUT, DIHEDRAL_LEGS, DIHEDRALS, FRAC, HAT, HI, LO, MOLS, WIDTH, S, angle_rows, box, dihedral_rows, pairs_sql, recursion_sql
from .registry import eliminated, q6, query, r6
from .relations import GROUPS, HIST, KT, RDF, groups, rdf


@query("l07_conjugate_gradient", f"{_G}, {eliminated('g', COLUMNS)} SELECT col, {q6('x')} AS x FROM x")
def l07(spark, sf_dir):
    triangle = normal.gram(entries(spark, sf_dir), target(spark, sf_dir), COLUMNS, weights(spark, sf_dir))
    return large.conjugate_gradient(triangle, COLUMNS, tolerance=1e-13).select("col", r6("x").alias("x"))


# density forces: four hat functions of the density for each ordered pair of groups
DENSITY_BASES, DENSITY_LO, DENSITY_HI, DENSITY_WIDTH = 4, 0.0, 3.0, 1.0
_SHAPE = "(pow(0.2::DOUBLE - sqrt(r2), 3) * (0.2::DOUBLE + 3.0 * sqrt(r2)) / pow(0.2::DOUBLE, 4))"
_SLOPE = "(-12.0 * sqrt(r2) * pow(0.2::DOUBLE - sqrt(r2), 2) / pow(0.2::DOUBLE, 4))"
_DENSE = f"""both_near AS (SELECT frame_id, i, j, ti, tj, dx, dy, dz, r2 FROM pairs UNION ALL SELECT frame_id, j, i, tj, ti, -dx, -dy, -dz, r2 FROM pairs),
grouped_near AS (SELECT n.*, h.group_id AS home, o.group_id AS other, o.weight FROM both_near n JOIN groups h ON h.type_id = ti JOIN groups o ON o.type_id = tj WHERE r2 < {CUT * CUT!r}::DOUBLE),
rho AS (SELECT frame_id, i, home, other, sum(weight * {_SHAPE}) AS density FROM grouped_near GROUP BY ALL),
spots AS (SELECT n.*, greatest(least(density, {DENSITY_HI}::DOUBLE - 1e-14), 0.0) / {DENSITY_WIDTH}::DOUBLE AS place, 4 * (2 * (n.home = 'low')::INT + (n.other = 'low')::INT) AS base FROM grouped_near n JOIN rho USING (frame_id, i, home, other)),
felt AS (SELECT *, base + floor(place)::INT AS col, 1 - (place - floor(place)) AS phi FROM spots UNION ALL SELECT *, base + floor(place)::INT + 1, place - floor(place) FROM spots)"""


def _density_first():
    return 4 * (2 * (F.col("home") == "low").cast("int") + (F.col("other") == "low").cast("int"))


def density_near(spark, sf_dir):
    sites = v.sites(spark, sf_dir)
    return neighbors.density_pairs(sites, groups(sites), CUT, box())


@query("a10_density_entries", f"""WITH {S}, {pairs_sql()}, {GROUPS}, {_DENSE}, ends AS (SELECT frame_id, site_id, d.dim, col, phi * d.s * weight * {_SLOPE} * d.part / sqrt(r2) AS v FROM felt, LATERAL (VALUES (i, 0, -1.0, dx), (i, 1, -1.0, dy), (i, 2, -1.0, dz), (j, 0, 1.0, dx), (j, 1, 1.0, dy), (j, 2, 1.0, dz)) d(site_id, dim, s, part) WHERE r2 > 0)
SELECT frame_id, site_id, dim, col, {q6('sum(v)')} AS v FROM ends GROUP BY ALL""")
def a10_density(spark, sf_dir):
    hats = lambda p: basis.hat(p, DENSITY_LO, DENSITY_HI, DENSITY_WIDTH)
    return normal.collected(density.density_entries(density_near(spark, sf_dir), "lucy", CUT, hats, _density_first())).select("frame_id", "site_id", "dim", "col", r6("v").alias("v"))


@query("a08_density_virial", f"WITH {S}, {pairs_sql()}, {GROUPS}, {_DENSE} SELECT frame_id, col, {q6(f'sum(phi * weight * {_SLOPE} * sqrt(r2))')} AS v FROM felt GROUP BY ALL")
def a08_density(spark, sf_dir):
    hats = lambda p: basis.hat(p, DENSITY_LO, DENSITY_HI, DENSITY_WIDTH)
    return density.density_virial(density_near(spark, sf_dir), "lucy", CUT, hats, _density_first()).select("frame_id", "col", r6("v").alias("v"))


# angles and dihedrals: hat functions of 30 and 60 degrees
_AK = "degrees((c * u{0} / ru - v{0} / rv) / (ru * sqrt(1 - c * c)))"
_AL = "degrees((c * v{0} / rv - u{0} / ru) / (rv * sqrt(1 - c * c)))"


def _hats(lo: float, hi: float, width: float, rows: str = "param") -> str:
    place = f"(greatest(least(p - ({lo}::DOUBLE), {hi - lo}::DOUBLE - 1e-14), 0.0) / {width}::DOUBLE)"
    return f"hat_rows AS (SELECT *, floor({place})::INT AS col, 1 - ({place} - floor({place})) AS phi FROM {rows} UNION ALL SELECT *, floor({place})::INT + 1, {place} - floor({place}) FROM {rows})"


@query("a10_angle_entries", f"""WITH {MOLS}, {BOTH}, {ANGLES}, {ANGLE_LEGS}, {ANG}, sized AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS ru, sqrt(vx * vx + vy * vy + vz * vz) AS rv FROM ang WHERE c IS NOT NULL),
param AS (SELECT k, j, l, degrees(acos(c)) AS p, {', '.join(f'{_AK.format(a)} AS gk{n}, {_AL.format(a)} AS gl{n}' for n, a in enumerate('xyz'))} FROM sized), {_hats(0.0, 180.0, 30.0)},
ends AS (SELECT d.site_id, d.dim, col, phi * d.part AS v FROM hat_rows, LATERAL (VALUES {', '.join(f'(k, {n}, gk{n}), (l, {n}, gl{n}), (j, {n}, -gk{n} - gl{n})' for n in range(3))}) d(site_id, dim, part))
SELECT site_id, dim, col, {q6('sum(v)')} AS v FROM ends GROUP BY ALL""")
def a10_angle(spark, sf_dir):
    at_k, at_l = g.angle_derivatives(g.cols("ux uy uz"), g.cols("vx vy vz"))
    legs = F.struct("k", "j", "l", "p", *[f"{leg}{a}" for leg in "uv" for a in "xyz"])
    rows = angle_rows(spark, sf_dir).select(F.lit(0).alias("frame_id"), F.inline(F.array(legs))).where("p is not null")  # legs are made before the gradients that use each many times
    made = normal.site_entries(rows, basis.hat(F.col("p"), 0.0, 180.0, 30.0), {"k": at_k, "l": at_l}, "j")
    return normal.collected(made).select("site_id", "dim", "col", r6("v").alias("v"))


_RAD_K = "(-sqrt(mx * mx + my * my + mz * mz) * p{0} / (px * px + py * py + pz * pz))"
_RAD_L = "(sqrt(mx * mx + my * my + mz * mz) * q{0} / (qx * qx + qy * qy + qz * qz))"


@query("a10_dihedral_entries", f"""WITH {MOLS}, {BOTH}, {DIHEDRALS}, {DIHEDRAL_LEGS},
pulls AS (SELECT *, (ex * mx + ey * my + ez * mz) / (mx * mx + my * my + mz * mz) AS s, (nx * mx + ny * my + nz * mz) / (mx * mx + my * my + mz * mz) AS t, {', '.join(f'{_RAD_K.format(a)} AS gk{n}, {_RAD_L.format(a)} AS gl{n}' for n, a in enumerate('xyz'))} FROM dih WHERE p IS NOT NULL),
param AS (SELECT k, i, j, l, p, {', '.join(f'gk{n}, gl{n}, t * gl{n} - (1 + s) * gk{n} AS gi{n}' for n in range(3))} FROM pulls), {_hats(-180.0, 180.0, 60.0)},
ends AS (SELECT d.site_id, d.dim, col % 6 AS col, phi * d.part AS v FROM hat_rows, LATERAL (VALUES {', '.join(f'(k, {n}, gk{n}), (l, {n}, gl{n}), (i, {n}, gi{n}), (j, {n}, -gk{n} - gl{n} - gi{n})' for n in range(3))}) d(site_id, dim, part))
SELECT site_id, dim, col::INT AS col, {q6('sum(v)')} AS v FROM ends GROUP BY ALL""")
def a10_dihedral(spark, sf_dir):
    """Dihedrals on the whole circle: seven hat functions, the last being the first; forces are per radian, as dihedral tables take them."""
    at = [g.cols(" ".join(f"{a}_{r}" for a in "xyz")) for r in ("k", "i", "j", "l")]
    at_k, at_l, at_i = g.dihedral_derivatives(*at, v.MOL_BOX, radians=True)
    held = F.struct("k", "i", "j", "l", "p", *[f"{a}_{r}" for r in "kijl" for a in "xyz"])
    rows = dihedral_rows(spark, sf_dir).select(F.lit(0).alias("frame_id"), F.inline(F.array(held))).where("p is not null")
    round_trip = F.transform(basis.hat(F.col("p"), -180.0, 180.0, 60.0), lambda b: F.struct(basis.periodic_index(b["idx"], 6).alias("idx"), b["val"].alias("val")))
    return normal.collected(normal.site_entries(rows, round_trip, {"k": at_k, "l": at_l, "i": at_i}, "j")).select("site_id", "dim", "col", r6("v").alias("v"))


# modes: three site types, whose six pairs are fitted, tabulated, both or neither
S3 = v.sites_sql(3)
MODE_ROWS = [(1, 1, "fm", 0, None), (1, 2, "fm+tab", 5, 0.3), (1, 3, "none", None, None), (2, 2, "tab", None, 0.5), (2, 3, "tab+fm", 10, 0.2), (3, 3, "fm", 15, None)]
MODE_COLUMNS, TABLE_LO, TABLE_WIDTH, TABLE_SIZE = 20, 0.02, 0.06, 4


def _table(scale: float | None) -> list[float] | None:
    return None if scale is None else [scale * (1.0 - 0.3 * k) for k in range(TABLE_SIZE)]


def mode_interactions(spark):
    """Six rows: one for each pair of three types."""
    rows = [(a, b, mode, LO, HI, first, _table(scale), TABLE_LO, TABLE_WIDTH) for a, b, mode, first, scale in MODE_ROWS]
    return spark.createDataFrame(rows, "t1 int, t2 int, mode string, lo double, hi double, first_column int, `table` array<double>, table_lo double, table_width double")


_SPEC = "spec(t1, t2, mode, first, vals) AS (VALUES " + ", ".join(f"({a}, {b}, '{mode}', {'NULL::INT' if first is None else first}, {'NULL::DOUBLE[]' if scale is None else '[' + ', '.join(f'{x!r}::DOUBLE' for x in _table(scale)) + ']'})" for a, b, mode, first, scale in MODE_ROWS) + ")"
_PLACE = f"least(greatest((p - {TABLE_LO}::DOUBLE) / {TABLE_WIDTH}::DOUBLE, 0.0), {TABLE_SIZE - 1}.0)"
_TERMS = f"""{_SPEC}, met AS (SELECT *, sqrt(r2) AS p FROM pairs JOIN spec ON t1 = least(ti, tj) AND t2 = greatest(ti, tj) WHERE r2 > 0 AND mode <> 'none' AND sqrt(r2) BETWEEN {LO}::DOUBLE AND {HI}::DOUBLE),
cut AS (SELECT *, least(floor({_PLACE}), {TABLE_SIZE - 2})::INT AS k FROM met),
terms AS (SELECT *, first + {HAT} AS col, 1 - ({FRAC}) AS val FROM cut WHERE mode LIKE '%fm%' UNION ALL SELECT *, first + {HAT} + 1, {FRAC} FROM cut WHERE mode LIKE '%fm%'
  UNION ALL SELECT *, {MODE_COLUMNS}, -(vals[k + 1] * (1 - ({_PLACE} - k)) + vals[k + 2] * ({_PLACE} - k)) FROM cut WHERE mode LIKE '%tab%')"""
_MODE_ROWS = f"""{S3}, {pairs_sql(CUTOFF)}, {_TERMS},
force_rows AS (SELECT frame_id, i AS site_id, d.dim, col, -val * d.part / p AS v FROM terms, LATERAL (VALUES (0, dx), (1, dy), (2, dz)) d(dim, part) UNION ALL SELECT frame_id, j, d.dim, col, val * d.part / p FROM terms, LATERAL (VALUES (0, dx), (1, dy), (2, dz)) d(dim, part)
  UNION ALL SELECT frame_id, site_id, d.dim, {MODE_COLUMNS}, d.f FROM sites, LATERAL (VALUES (0, fx), (1, fy), (2, fz)) d(dim, f)),
force_system AS (SELECT frame_id, site_id, dim, col, sum(v) AS v FROM force_rows GROUP BY ALL)"""


def mode_terms(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, 3), CUTOFF, box()).where("r2 > 0")
    typed = near.select("*", F.least("type_id_i", "type_id_j").alias("t1"), F.greatest("type_id_i", "type_id_j").alias("t2"), F.sqrt("r2").alias("p"))
    return dispatch.with_interactions(typed, mode_interactions(spark), ["t1", "t2"])


def mode_hats(p):
    return basis.hat(p, LO, HI, WIDTH)


def mode_system(spark, sf_dir, virial: bool):
    met = mode_terms(spark, sf_dir)
    forces = dispatch.pair_terms(met, mode_hats, MODE_COLUMNS)
    target_rows = normal.targets(v.sites(spark, sf_dir, 3))
    if not virial:
        return dispatch.system(forces, target_rows, MODE_COLUMNS)
    wanted = v.sites(spark, sf_dir, 3).select("frame_id").distinct().select("frame_id", (0.5 + 0.1 * (F.col("frame_id") % 7)).alias("virial"))
    return dispatch.system(forces, target_rows, MODE_COLUMNS, dispatch.virial_terms(met, mode_hats, MODE_COLUMNS), wanted, virial_weight=2.0)


@query("a09_modes", f"WITH {_MODE_ROWS} SELECT frame_id, site_id, dim, col::INT AS col, {q6('v')} AS v FROM force_system")
def a09(spark, sf_dir):
    return mode_system(spark, sf_dir, False).select("frame_id", "site_id", "dim", "col", r6("v").alias("v"))


_VIRIAL = f"""virial_rows AS (SELECT frame_id, col, sum(val * p) AS v FROM terms GROUP BY ALL UNION ALL SELECT frame_id, {MODE_COLUMNS}, 0.5::DOUBLE + 0.1::DOUBLE * (frame_id % 7) FROM (SELECT DISTINCT frame_id FROM sites)),
both_systems AS (SELECT * FROM force_system UNION ALL SELECT frame_id, -1, 0, col, sqrt(2.0::DOUBLE) * sum(v) FROM virial_rows GROUP BY frame_id, col),
g AS (SELECT a.col::INT AS i, b.col::INT AS j, sum(a.v * b.v) AS v FROM both_systems a JOIN both_systems b USING (frame_id, site_id, dim) WHERE a.col <= b.col GROUP BY 1, 2)"""


@query("a08_virial_equations", f"WITH {_MODE_ROWS}, {_VIRIAL} SELECT i, j, {q6('v')} AS v FROM g")
def a08_equations(spark, sf_dir):
    """Normal equations of force rows and one virial row a frame, each frame's with its own target."""
    return normal.gram_rows(mode_system(spark, sf_dir, True), MODE_COLUMNS).select("i", "j", r6("v").alias("v"))


@query("j14_virial_solution", f"WITH RECURSIVE {_MODE_ROWS}, {_VIRIAL}, {eliminated('g', MODE_COLUMNS)} SELECT col, {q6('x')} AS x FROM x")
def j14_virial(spark, sf_dir):
    """The fit under the virial constraint, with tabulated interactions taken from both targets."""
    return large.solution(normal.gram_rows(mode_system(spark, sf_dir, True), MODE_COLUMNS), MODE_COLUMNS).select("col", r6("x").alias("x"))


# replicas and blocks: draws at an arithmetic rank, blocks of two frames
REPLICAS, DRAWS, RIDGE = 3, 8, 0.1
_DRAWN = f"ranked AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT frame_id FROM sites)), drawn AS (SELECT r.r::INT AS replica, frame_id, count(*)::DOUBLE AS weight FROM range(0, {REPLICAS}) r(r), range(0, {DRAWS}) d(d), ranked WHERE (r.r * 31 + d.d * 17 + 3) % n = k GROUP BY ALL)"


def drawn_weights(spark, sf_dir):
    return normal.bootstrap_weights(v.sites(spark, sf_dir), REPLICAS, DRAWS, draw=F.col("replica") * 31 + F.col("draw") * 17 + 3)


@query("a14_arithmetic_draws", f"WITH {v.sites_sql()}, {_DRAWN} SELECT replica, frame_id, weight FROM drawn")
def a14(spark, sf_dir):
    return drawn_weights(spark, sf_dir)


def system_rows(spark, sf_dir):
    return normal.collected(entries(spark, sf_dir)).union(target(spark, sf_dir).select("frame_id", "site_id", "dim", F.lit(COLUMNS).alias("col"), F.col("f").alias("v")))


def replica_blocks(spark, sf_dir):
    """(frame_id, weight, replica, block): all frames as replica -1, and the drawn ones; blocks of two frames."""
    own = v.sites(spark, sf_dir).select("frame_id").distinct().select(F.lit(-1).alias("replica"), "frame_id", F.lit(1.0).alias("weight"))
    return own.union(drawn_weights(spark, sf_dir)).select("frame_id", "weight", F.col("replica").cast("long").alias("replica"), F.floor(F.col("frame_id") / 2).alias("block"))


def replica_solutions(spark, sf_dir):
    """(replica, col, x, n): mean over blocks of each block's regularised solution, all replicas and blocks in one pass."""
    triangles = normal.gram_rows(system_rows(spark, sf_dir), COLUMNS, replica_blocks(spark, sf_dir), by=("replica", "block"))
    return solve.block_average(solve.by_group(triangles, COLUMNS, ["replica", "block"], ridge=RIDGE), by=("replica",))


_AVERAGED = f"""{FIT}, {_DRAWN}, weighed AS (SELECT frame_id, weight, (replica::INT * 1000000 + frame_id // 2)::BIGINT AS key FROM (SELECT replica, frame_id, weight FROM drawn UNION ALL SELECT -1, frame_id, 1.0 FROM ranked)),
full_rows AS (SELECT * FROM entries UNION ALL SELECT frame_id, site_id, dim, {COLUMNS}, f FROM target),
plain AS (SELECT key, a.col::INT AS i, b.col::INT AS j, sum(w.weight * a.v * b.v) AS v FROM full_rows a JOIN full_rows b USING (frame_id, site_id, dim) JOIN weighed w USING (frame_id) WHERE a.col <= b.col GROUP BY 1, 2, 3),
norms AS (SELECT key, c, sqrt(sum(v * v)) AS norm FROM (SELECT key, j AS c, v FROM plain WHERE j < {COLUMNS} UNION ALL SELECT key, i, v FROM plain WHERE j < {COLUMNS} AND i < j) GROUP BY ALL),
g AS (SELECT p.key, i, j, v + CASE WHEN i = j AND i < {COLUMNS} THEN {RIDGE**2!r}::DOUBLE * norm ELSE 0 END AS v FROM plain p LEFT JOIN norms n ON n.key = p.key AND n.c = p.i),
{eliminated('g', COLUMNS, 'key')},
averaged AS (SELECT floor(key / 1000000.0)::BIGINT AS replica, col, coalesce(avg(x) FILTER (WHERE x <> 0 AND abs(x) < 1000), 0) AS x, count(*) FILTER (WHERE x <> 0 AND abs(x) < 1000) AS n FROM x GROUP BY ALL)"""


@query("a17_replica_blocks", f"WITH RECURSIVE {_AVERAGED} SELECT replica, col, {q6('x')} AS x, n FROM averaged")
def a17(spark, sf_dir):
    return replica_solutions(spark, sf_dir).select("replica", "col", r6("x").alias("x"), "n")


@query("k09_bootstrap_error", f"WITH RECURSIVE {_AVERAGED} SELECT col, {q6('sqrt(greatest(sum(x * x) - sum(x) * sum(x) / count(x), 0)) / count(x)')} AS se FROM averaged GROUP BY col")
def k09(spark, sf_dir):
    return solve.standard_error(replica_solutions(spark, sf_dir).withColumnRenamed("x", "v"), ["col"]).select("col", r6("se").alias("se"))


@query("a15_factor_squared", f"WITH {FIT}, full_rows AS (SELECT * FROM entries UNION ALL SELECT frame_id, site_id, dim, {COLUMNS}, f FROM target) SELECT a.col::INT AS i, b.col::INT AS j, {q6('sum(a.v * b.v)')} AS v FROM full_rows a JOIN full_rows b USING (frame_id, site_id, dim) WHERE a.col <= b.col GROUP BY 1, 2 HAVING abs(sum(a.v * b.v)) >= 1e-6")
def a15_squared(spark, sf_dir):
    """R'R of the tree factorisation, which is [A f]'[A f] whatever the signs of R's rows."""
    r = normal.tsqr(entries(spark, sf_dir), target(spark, sf_dir), COLUMNS)
    a, b = r.select(F.col("i").alias("k"), F.col("j").alias("i"), F.col("v").alias("a")), r.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return a.join(b, "k").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v")).where("abs(v) >= 1e-6").select("i", "j", r6("v").alias("v"))


_LINE = f"""{S2}, {pairs_sql(CUTOFF)}, p1 AS (SELECT *, sqrt(r2) AS r FROM pairs WHERE r2 > 0), b AS (SELECT *, 0 AS col, 1 - (r / 0.2::DOUBLE) AS phi FROM p1 UNION ALL SELECT *, 1, r / 0.2::DOUBLE FROM p1),
raw AS (SELECT frame_id, i AS site_id, d.dim, col, -phi * d.part / r AS v FROM b, LATERAL (VALUES (0, dx), (1, dy), (2, dz)) d(dim, part) UNION ALL SELECT frame_id, j, d.dim, col, phi * d.part / r FROM b, LATERAL (VALUES (0, dx), (1, dy), (2, dz)) d(dim, part)),
two AS (SELECT frame_id, site_id, dim, coalesce(sum(v) FILTER (WHERE col = 0), 0) AS a0, coalesce(sum(v) FILTER (WHERE col = 1), 0) AS a1 FROM raw GROUP BY ALL),
s AS (SELECT sum(a0 * a0) AS p, sum(a0 * a1) AS q, sum(a1 * a1) AS r FROM two)"""


@query("l09_singular_values", f"WITH {_LINE} SELECT 0 AS k, {q6('sqrt((p + r + sqrt((p - r) * (p - r) + 4 * q * q)) / 2)')} AS s FROM s UNION ALL SELECT 1, {q6('sqrt((p + r - sqrt((p - r) * (p - r) + 4 * q * q)) / 2)')} FROM s")
def l09(spark, sf_dir):
    """Singular values of the force matrix itself, from the triangle of its tree factorisation."""
    near = neighbors.pairs(v.sites(spark, sf_dir, TYPES), CUTOFF, box()).where("r2 > 0")
    f = F.sqrt("r2") / CUTOFF
    line = F.array(F.struct(F.lit(0).alias("idx"), (1 - f).alias("val")), F.struct(F.lit(1).alias("idx"), f.alias("val")))
    _, s, _ = solve.from_factor(normal.tsqr(normal.pair_entries(near, line), target(spark, sf_dir), 2), 2)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "k int, s double").select("k", r6("s").alias("s"))


# inverted distributions: a straight line, and B-splines, through each pair's potentials
def inverted_bins(spark, sf_dir):
    bins = ranges.boltzmann(rdf(spark, sf_dir), KT)
    ends = bins.groupBy("t1", "t2").agg(F.min("centre").alias("lo"), F.max("centre").alias("hi"))
    return bins.join(ends, ["t1", "t2"]).where("hi > lo")


_INVERTED = f"{S}, {pairs_sql()}, {HIST}, {RDF}, bins AS (SELECT t1, t2, bin, centre, CASE WHEN g > 0 THEN -{KT!r}::DOUBLE * ln(g) ELSE 100 END AS u, min(centre) OVER (PARTITION BY t1, t2) AS lo, max(centre) OVER (PARTITION BY t1, t2) AS hi FROM rdf)"


@query("l14_line_fit", f"WITH {_INVERTED}, c AS (SELECT t1, t2, regr_intercept(u, (centre - lo) / (hi - lo)) AS a, regr_slope(u, (centre - lo) / (hi - lo)) AS b FROM bins WHERE hi > lo GROUP BY t1, t2) SELECT t1, t2, 0 AS idx, {q6('a')} AS c FROM c UNION ALL SELECT t1, t2, 1, {q6('a + b')} FROM c")
def l14_line(spark, sf_dir):
    """Two hat functions over each pair's range: the least-squares line through its inverted distribution."""
    hats = lambda p: basis.hat(p, F.col("lo"), F.col("hi"), F.col("hi") - F.col("lo"))
    return inversion.fit(inverted_bins(spark, sf_dir), ["t1", "t2"], hats, 2).select("t1", "t2", "idx", r6("c").alias("c"))


SPLINE_KNOTS = [0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 3.0, 3.0, 3.0]
_UNIT = f"(SELECT *, least(greatest((centre - lo + 1e-6) / ((hi - lo + 2e-6) / 3), 0.0), 3.0) AS p FROM bins WHERE hi > lo)"
_SPLINE_ROWS = "spline_rows AS (" + " UNION ALL ".join(f"SELECT t1, t2, bin, {n} AS col, {recursion_sql(n, 4, SPLINE_KNOTS)} AS v FROM (SELECT *, 3 + (p >= 1)::INT + (p >= 2)::INT AS span FROM {_UNIT})" for n in range(6)) + " UNION ALL SELECT t1, t2, bin, 6, u FROM bins WHERE hi > lo)"


@query("k13_inversion_equations", f"WITH {_INVERTED}, {_SPLINE_ROWS} SELECT a.t1, a.t2, a.col::INT AS i, b.col::INT AS j, {q6('sum(a.v * b.v)')} AS v FROM spline_rows a JOIN spline_rows b USING (t1, t2, bin) WHERE a.col <= b.col AND a.v <> 0 AND b.v <> 0 GROUP BY ALL")
def k13(spark, sf_dir):
    """Normal equations of cubic B-splines, six coefficients each, through every pair's inverted distribution."""
    spline = basis.bspline_between(6, 4)
    rows = inversion.design(inverted_bins(spark, sf_dir), ["t1", "t2"], lambda p: spline(p, F.col("lo"), F.col("hi")))
    return inversion.equations(rows.where("v <> 0"), ["t1", "t2"], 6).select("t1", "t2", "i", "j", r6("v").alias("v"))


@query("l14_spline_values", f"""WITH RECURSIVE {_INVERTED}, {_SPLINE_ROWS}, numbered AS (SELECT t1 * 1000 + t2 AS key, * FROM spline_rows), many AS (SELECT key FROM numbered WHERE col = 6 GROUP BY key HAVING count(*) >= 12),
g AS (SELECT key, a.col AS i, b.col AS j, sum(a.v * b.v) AS v FROM numbered a JOIN numbered b USING (key, bin) WHERE key IN (SELECT key FROM many) AND a.col <= b.col GROUP BY 1, 2, 3), {eliminated('g', 6, 'key')}
SELECT (n.key // 1000)::INT AS t1, (n.key % 1000)::INT AS t2, n.bin, floor(sum(n.v * x.x) * 1e4 + 0.5) / 1e4 AS u FROM numbered n JOIN x ON x.key = n.key AND x.col = n.col WHERE n.col < 6 GROUP BY ALL""")
def l14_spline(spark, sf_dir):
    """The fitted splines at their own bins, for pairs with twelve bins and more (fewer leave coefficients free)."""
    bins = inverted_bins(spark, sf_dir)
    many = bins.groupBy("t1", "t2").agg(F.count("*").alias("k")).where("k >= 12").select("t1", "t2")
    model = output.ClassModel("nonbonded", "bspline", 0.01, n_coef=6, order=4)
    bins = bins.join(many, ["t1", "t2"]).select("t1", "t2", "bin", "centre", "u", "lo", "hi")
    fitted = inversion.fit(bins, ["t1", "t2"], model.entries, 6)
    return output.evaluate(bins.drop("u"), fitted, ["t1", "t2"], model, at="centre").select("t1", "t2", "bin", (F.floor(F.col("value") * 1e4 + 0.5) / 1e4).alias("u"))


# coefficients to tables: three pair interactions of a fit, evaluated, finished and written
_SPECS = [(1, 1, 0), (1, 2, 1), (2, 2, 2)]


def pair_specs(spark):
    """Three rows: the pairs of two types, in the fit's order of columns."""
    return spark.createDataFrame([(a, b, LO, HI, BASES * k, BASES) for a, b, k in _SPECS], "t1 int, t2 int, lo double, hi double, first_column int, n_basis int")


PAIR_MODEL = output.ClassModel("nonbonded", "linear", 0.01, cutoff=CUTOFF, width=WIDTH)


def fitted_coefficients(spark, sf_dir):
    found = large.solution(normal.gram(entries(spark, sf_dir), target(spark, sf_dir), COLUMNS, weights(spark, sf_dir)), COLUMNS)
    return output.interaction_coefficients(found, pair_specs(spark), ["t1", "t2"], PAIR_MODEL)


_COEFS = f"{_G}, {eliminated('g', COLUMNS)}, coefs AS (SELECT s.t1, s.t2, (col - {BASES} * s.k)::INT AS idx, x AS c FROM x JOIN (VALUES {', '.join(map(str, _SPECS))}) s(t1, t2, k) ON col // {BASES} = s.k)"
_ON_GRID = f"least(greatest(axis - {LO}::DOUBLE, 0.0), {HI}::DOUBLE - {LO}::DOUBLE - 1e-14) / {WIDTH}::DOUBLE"
_FORCES = f"""{_COEFS}, grid AS (SELECT DISTINCT t1, t2, {HI}::DOUBLE - n * 0.01::DOUBLE AS axis FROM coefs, range(0, {int((HI - LO) / 0.01 + 1e-6) + 1}) r(n)),
forces AS (SELECT q.t1, q.t2, axis, a.c * (1 - ({_ON_GRID} - floor({_ON_GRID}))) + b.c * ({_ON_GRID} - floor({_ON_GRID})) AS value FROM grid q JOIN coefs a ON a.t1 = q.t1 AND a.t2 = q.t2 AND a.idx = floor({_ON_GRID})::INT JOIN coefs b ON b.t1 = q.t1 AND b.t2 = q.t2 AND b.idx = a.idx + 1)"""


@query("k07_coefficients", f"{_COEFS} SELECT t1, t2, idx, {q6(f'{LO}::DOUBLE + idx * {WIDTH}::DOUBLE')} AS knot, {q6('c')} AS c FROM coefs")
def k07(spark, sf_dir):
    got = output.coefficient_rows(pair_specs(spark), fitted_coefficients(spark, sf_dir), ["t1", "t2"], PAIR_MODEL)
    return got.select("t1", "t2", "idx", r6("knot").alias("knot"), r6("c").alias("c"))


@query("w08_force_table", f"{_FORCES} SELECT t1, t2, {q6('axis')} AS axis, {q6('value')} AS value FROM forces")
def w08_forces(spark, sf_dir):
    return output.force_table(pair_specs(spark), fitted_coefficients(spark, sf_dir), ["t1", "t2"], PAIR_MODEL).select("t1", "t2", r6("axis").alias("axis"), r6("value").alias("value"))


_FINISHED = f"""{_FORCES}, marked AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY t1, t2) AS n, lead(value) OVER w AS nxt FROM forces WINDOW w AS (PARTITION BY t1, t2 ORDER BY axis)),
sound AS (SELECT *, coalesce(min(k) FILTER (WHERE nxt <= value AND k <= n - 1 AND value >= 0) OVER (PARTITION BY t1, t2), min(k) FILTER (WHERE nxt <= value AND k <= n - 1) OVER (PARTITION BY t1, t2)) AS origin FROM marked),
anchored AS (SELECT *, max(value) FILTER (WHERE k = origin) OVER (PARTITION BY t1, t2) AS v0, max(nxt) FILTER (WHERE k = origin) OVER (PARTITION BY t1, t2) AS v1 FROM sound),
repaired AS (SELECT t1, t2, axis, CASE WHEN k < origin THEN v0 - (origin - k) * (v1 - v0) ELSE value END AS value FROM anchored),
ends AS (SELECT t1, t2, min(axis) AS low, min_by(value, axis) AS first_value, (array_agg(value ORDER BY axis))[2] AS second FROM repaired GROUP BY ALL),
padded AS (SELECT * FROM repaired UNION ALL SELECT t1, t2, low - m * 0.01::DOUBLE, first_value - m * (second - first_value) FROM ends, range(1, 100) r(m) WHERE m <= floor((low - 0.01::DOUBLE) / 0.01::DOUBLE + 1e-6)),
closed AS (SELECT t1, t2, axis, CASE WHEN axis > {CUTOFF}::DOUBLE - 1e-6 THEN 0 ELSE value END AS value FROM padded),
parts AS (SELECT *, coalesce(0.5 * (lead(axis) OVER w - axis) * (value + lead(value) OVER w), 0) AS part FROM closed WINDOW w AS (PARTITION BY t1, t2 ORDER BY axis)),
done AS (SELECT t1, t2, axis, value, sum(part) OVER (PARTITION BY t1, t2 ORDER BY axis DESC ROWS UNBOUNDED PRECEDING) AS u FROM parts)"""


@query("w10_finished_table", f"{_FINISHED} SELECT t1, t2, {q6('axis')} AS axis, {q6('value')} AS value, {q6('u')} AS u FROM done")
def w10_finished(spark, sf_dir):
    got = output.finished(pair_specs(spark), fitted_coefficients(spark, sf_dir), ["t1", "t2"], PAIR_MODEL)
    return got.select("t1", "t2", r6("axis").alias("axis"), r6("value").alias("value"), r6("u").alias("u"))


@query("k14_table_lines", f"{_FINISHED}, r AS (SELECT *, row_number() OVER (PARTITION BY t1, t2 ORDER BY axis) AS k FROM done) SELECT 'nonbonded' AS kind, t1, t2, (k + 10)::INT AS line_no, printf('%d %.6f %.6f %.6f', k, axis, u, value) AS line FROM r UNION ALL SELECT 'nonbonded', t1, t2, 2, printf('N %d R %.6f %.6f', count(*), min(axis), max(axis)) FROM done GROUP BY t1, t2")
def k14(spark, sf_dir):
    """From the fit to the lines of each interaction's table file."""
    done = output.finished(pair_specs(spark), fitted_coefficients(spark, sf_dir), ["t1", "t2"], PAIR_MODEL)
    return output.table_lines([(done, PAIR_MODEL)], ["t1", "t2"])


# a stream of frames: each site's force along an axis as a function of its place on it, three hat functions for all axes
FIELD_COLUMNS = 3


def field_rows(sites):
    """Rows of [A f] of an external field, for two runs: even and odd frames."""
    cells = F.array(*[F.struct(F.lit(n).alias("dim"), F.col(a).alias("x"), F.col(f"f{a}").alias("f")) for n, a in enumerate("xyz")])
    wide = sites.withColumn("c", F.explode(cells)).select((F.col("frame_id") % 2).alias("run"), "frame_id", "site_id", "c.dim", "c.x", "c.f")
    terms = F.concat(basis.hat(F.col("x"), 0.0, v.BOX, 0.5), F.array(F.struct(F.lit(FIELD_COLUMNS).alias("idx"), F.col("f").alias("val"))))
    return wide.withColumn("b", F.explode(terms)).select("run", "frame_id", "site_id", "dim", F.col("b.idx").alias("col"), F.col("b.val").alias("v"), F.array(*[F.lit(v.BOX)] * 3).alias("box"))


_FIELD = f"""{v.sites_sql()}, axes AS (SELECT frame_id % 2 AS run, site_id, d.dim, least(greatest(d.x, 0.0), {v.BOX}::DOUBLE - 1e-14) / 0.5::DOUBLE AS place, d.f FROM sites, LATERAL (VALUES (0, x, fx), (1, y, fy), (2, z, fz)) d(dim, x, f)),
field AS (SELECT run, site_id, dim, floor(place)::INT AS col, 1 - (place - floor(place)) AS v FROM axes UNION ALL SELECT run, site_id, dim, floor(place)::INT + 1, place - floor(place) FROM axes UNION ALL SELECT run, site_id, dim, {FIELD_COLUMNS}, f FROM axes)"""


@query("c10_streaming_factor", f"WITH {_FIELD} SELECT a.run::BIGINT AS run, a.col AS i, b.col AS j, {q6('sum(a.v * b.v)')} AS v FROM field a JOIN field b USING (run, site_id, dim) WHERE a.col <= b.col GROUP BY ALL")
def c10(spark, sf_dir):
    """Frames as a stream; the state's factors, squared and summed, are the batch's normal equations."""
    import uuid

    from ..streaming import stateful

    base = f"{large.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    arriving = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema).parquet(f"{sf_dir}/embeddings.[p]arquet")  # a pattern, so that a file does as well as a folder
    stateful.run_factors(field_rows(v.embedding_sites(arriving)), FIELD_COLUMNS, f"{base}/out", f"{base}/state").awaitTermination()
    return stateful.merged_triangle(spark, f"{base}/out", FIELD_COLUMNS).select("run", "i", "j", r6("v").alias("v"))
