"""Queries of projections and scalar functions (P*, F*)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import basis, kernels, keys
from ..functions import geometry as g
from ..operators import neighbors, parameters, topology
from ..sources import views as v
from .registry import q6, query, r6

CUT = 0.2
S = v.sites_sql()
#: The same sites in whole frames.
W = v.sites_sql(whole=True)


def image(d: str, side: float) -> str:
    return f"CASE WHEN {d} > {side / 2}::DOUBLE THEN {d} - {side}::DOUBLE WHEN {d} < -{side / 2}::DOUBLE THEN {d} + {side}::DOUBLE ELSE {d} END"


def pairs_sql(cutoff: float = CUT, sites: str = "sites") -> str:
    """pairs(frame_id, i, j, ti, tj, dx, dy, dz, r2) of the unit box, from all pairs."""
    d = ", ".join(f"{image(f'(b.{c} - a.{c})', v.BOX)} AS d{c}" for c in "xyz")
    return f"""apart AS (SELECT a.frame_id, a.site_id AS i, b.site_id AS j, a.type_id AS ti, b.type_id AS tj, {d} FROM {sites} a JOIN {sites} b ON a.frame_id = b.frame_id AND a.site_id < b.site_id),
pairs AS (SELECT * FROM (SELECT *, dx * dx + dy * dy + dz * dz AS r2 FROM apart) WHERE r2 <= {cutoff * cutoff!r}::DOUBLE)"""


def box() -> tuple[float, float, float]:
    return (v.BOX,) * 3


MOLS = f"{v.MOL_SQL}, {v.BONDS_SQL}"
BOTH = "both_ways AS (SELECT i AS a, j AS b FROM bonds UNION SELECT j, i FROM bonds)"
ANGLES = "angles AS (SELECT x.b AS k, x.a AS j, y.b AS l FROM both_ways x JOIN both_ways y ON x.a = y.a AND x.b < y.b)"
DIHEDRALS = "dihedrals AS (SELECT x.b AS k, c.a AS i, c.b AS j, y.b AS l FROM both_ways c JOIN both_ways x ON x.a = c.a AND x.b <> c.b JOIN both_ways y ON y.a = c.b AND y.b <> c.a AND y.b <> x.b WHERE c.a < c.b)"


def leg(a: str, b: str, name: str) -> str:
    """Components of b - a by nearest image of the molecules' box."""
    return ", ".join(f"{image(f'({b}.{c} - {a}.{c})', side)} AS {name}{c}" for c, side in zip("xyz", v.MOL_BOX, strict=True))


BOND_LEGS = f"legs AS (SELECT o.i, o.j, p.type_id AS type_i, q.type_id AS type_j, {leg('p', 'q', 'd')} FROM bonds o JOIN mol p ON p.site_id = o.i JOIN mol q ON q.site_id = o.j)"
ANGLE_LEGS = f"legs AS (SELECT o.k, o.j, o.l, c.type_id AS type_j, p.type_id AS type_k, q.type_id AS type_l, {leg('c', 'p', 'u')}, {leg('c', 'q', 'v')} FROM angles o JOIN mol c ON c.site_id = o.j JOIN mol p ON p.site_id = o.k JOIN mol q ON q.site_id = o.l)"
DIHEDRAL_LEGS = f"""legs AS (SELECT o.k, o.i, o.j, o.l, a.type_id AS type_k, b.type_id AS type_i, c.type_id AS type_j, d.type_id AS type_l, {leg('a', 'b', 'e')}, {leg('b', 'c', 'm')}, {leg('c', 'd', 'n')}
  FROM dihedrals o JOIN mol a ON a.site_id = o.k JOIN mol b ON b.site_id = o.i JOIN mol c ON c.site_id = o.j JOIN mol d ON d.site_id = o.l),
normals AS (SELECT *, ey * mz - ez * my AS px, ez * mx - ex * mz AS py, ex * my - ey * mx AS pz, my * nz - mz * ny AS qx, mz * nx - mx * nz AS qy, mx * ny - my * nx AS qz FROM legs),
turned AS (SELECT *, degrees(acos(greatest(least((px * qx + py * qy + pz * qz) / nullif(sqrt(px * px + py * py + pz * pz) * sqrt(qx * qx + qy * qy + qz * qz), 0), 0.999999::DOUBLE), -0.999999::DOUBLE))) AS size, px * nx + py * ny + pz * nz AS side,
  (px * qx + py * qy + pz * qz) / nullif(sqrt(px * px + py * py + pz * pz) * sqrt(qx * qx + qy * qy + qz * qz), 0) AS c FROM normals),
dih AS (SELECT *, CASE WHEN c IS NULL THEN NULL WHEN side < 0 THEN -size ELSE size END AS p FROM turned)"""
COS = "greatest(least((ux * vx + uy * vy + uz * vz) / nullif(sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz), 0), 0.999999::DOUBLE), -0.999999::DOUBLE)"
ANG = f"ang AS (SELECT *, CASE WHEN sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz) <> 0 THEN {COS} END AS c FROM legs)"


def molecules(spark, sf_dir):
    mol = v.molecules(spark, sf_dir)
    return mol, v.bonds(mol)


@query("p01_wrap", f"WITH {S} SELECT site_id, {q6('x')} AS x, {q6('y')} AS y, {q6('z')} AS z FROM sites")
def p01(spark, sf_dir):
    return v.sites(spark, sf_dir).select("site_id", *[r6(c).alias(c) for c in "xyz"])


@query("p02_min_image", f"WITH {MOLS}, {BOND_LEGS} SELECT i, j, {q6('dx')} AS dx, {q6('dy')} AS dy, {q6('dz')} AS dz FROM legs")
def p02(spark, sf_dir):
    mol, bonds = molecules(spark, sf_dir)
    rows = parameters.bonded(bonds.select("i", "j"), mol, "bond", v.MOL_BOX)
    d = g.displacement(g.cols("x_i y_i z_i"), g.cols("x_j y_j z_j"), v.MOL_BOX)
    return rows.select("i", "j", *[r6(x).alias(f"d{c}") for c, x in zip("xyz", d, strict=True)])


def _legs(rows):
    u = g.displacement(g.cols("x_j y_j z_j"), g.cols("x_k y_k z_k"), v.MOL_BOX)
    w = g.displacement(g.cols("x_j y_j z_j"), g.cols("x_l y_l z_l"), v.MOL_BOX)
    return rows.select("k", "j", "l", "type_k", "type_j", "type_l", "p", *[x.alias(f"u{c}") for c, x in zip("xyz", u, strict=True)], *[x.alias(f"v{c}") for c, x in zip("xyz", w, strict=True)])


def angle_rows(spark, sf_dir):
    mol, bonds = molecules(spark, sf_dir)
    return _legs(parameters.bonded(topology.angles(bonds), mol, "angle", v.MOL_BOX))


def dihedral_rows(spark, sf_dir):
    mol, bonds = molecules(spark, sf_dir)
    return parameters.bonded(topology.dihedrals(bonds), mol, "dihedral", v.MOL_BOX)


@query("p03_products", f"WITH {MOLS}, {BOTH}, {ANGLES}, {ANGLE_LEGS} SELECT k, j, l, {q6('ux * vx + uy * vy + uz * vz')} AS dot, {q6('uy * vz - uz * vy')} AS cx, {q6('uz * vx - ux * vz')} AS cy, {q6('ux * vy - uy * vx')} AS cz FROM legs")
def p03(spark, sf_dir):
    u, w = g.cols("ux uy uz"), g.cols("vx vy vz")
    return angle_rows(spark, sf_dir).select("k", "j", "l", r6(g.dot(u, w)).alias("dot"), *[r6(x).alias(f"c{c}") for c, x in zip("xyz", g.cross(u, w), strict=True)])


@query("p04_distance", f"WITH {MOLS}, {BOND_LEGS} SELECT i, j, {q6('sqrt(dx * dx + dy * dy + dz * dz)')} AS p FROM legs")
def p04(spark, sf_dir):
    mol, bonds = molecules(spark, sf_dir)
    return parameters.bonded(bonds.select("i", "j"), mol, "bond", v.MOL_BOX).select("i", "j", r6("p").alias("p"))


@query("p05_distance_derivative", f"WITH {W}, {pairs_sql()} SELECT i, j, {q6('sqrt(r2)')} AS r, {q6('dx / sqrt(r2)')} AS gx, {q6('dy / sqrt(r2)')} AS gy, {q6('dz / sqrt(r2)')} AS gz FROM pairs WHERE r2 > 0")
def p05(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).where("r2 > 0")
    r = F.sqrt("r2")
    return near.select("i", "j", r6(r).alias("r"), *[r6(F.col(f"d{c}") / r).alias(f"g{c}") for c in "xyz"])


@query("p06_angle", f"WITH {MOLS}, {BOTH}, {ANGLES}, {ANGLE_LEGS}, {ANG} SELECT k, j, l, {q6('degrees(acos(c))')} AS p FROM ang")
def p06(spark, sf_dir):
    return angle_rows(spark, sf_dir).select("k", "j", "l", r6("p").alias("p"))


_AD = "degrees((c * u{0} / ru - v{0} / rv) / (ru * sqrt(1 - c * c)))"
_AE = "degrees((c * v{0} / rv - u{0} / ru) / (rv * sqrt(1 - c * c)))"


@query("p07_angle_derivatives", f"WITH {MOLS}, {BOTH}, {ANGLES}, {ANGLE_LEGS}, {ANG}, sized AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS ru, sqrt(vx * vx + vy * vy + vz * vz) AS rv FROM ang) SELECT k, j, l, " + ", ".join(f"{q6(_AD.format(a))} AS at_k_{a}, {q6(_AE.format(a))} AS at_l_{a}" for a in "xyz") + " FROM sized")
def p07(spark, sf_dir):
    u, w = g.cols("ux uy uz"), g.cols("vx vy vz")
    at_u, at_v = g.angle_derivatives(u, w)
    rows = angle_rows(spark, sf_dir)
    return rows.select("k", "j", "l", *[r6(x).alias(f"at_k_{c}") for c, x in zip("xyz", at_u, strict=True)], *[r6(x).alias(f"at_l_{c}") for c, x in zip("xyz", at_v, strict=True)])


@query("p09_stillinger_weber", f"WITH {W}, {pairs_sql()} SELECT i, j, {q6('CASE WHEN sqrt(r2) < 0.2::DOUBLE THEN exp(0.12::DOUBLE / (sqrt(r2) - 0.2::DOUBLE)) ELSE 0 END')} AS w FROM pairs")
def p09(spark, sf_dir):
    return neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).select("i", "j", r6(g.stillinger_weber(F.sqrt("r2"), CUT, 0.12)).alias("w"))


@query("p10_dihedral", f"WITH {MOLS}, {BOTH}, {DIHEDRALS}, {DIHEDRAL_LEGS} SELECT k, i, j, l, {q6('p')} AS p FROM dih")
def p10(spark, sf_dir):
    return dihedral_rows(spark, sf_dir).select("k", "i", "j", "l", r6("p").alias("p"))


_B = "sqrt(mx * mx + my * my + mz * mz)"
_PP, _QQ = "nullif(px * px + py * py + pz * pz, 0)", "nullif(qx * qx + qy * qy + qz * qz, 0)"


@query("p11_dihedral_derivatives", f"WITH {MOLS}, {BOTH}, {DIHEDRALS}, {DIHEDRAL_LEGS} SELECT k, i, j, l, " + ", ".join(f"{q6(f'degrees(-{_B} * p{a} / {_PP})')} AS at_k_{a}, {q6(f'degrees({_B} * q{a} / {_QQ})')} AS at_l_{a}" for a in "xyz") + " FROM dih")
def p11(spark, sf_dir):
    at = [g.cols(" ".join(f"{a}_{r}" for a in "xyz")) for r in ("k", "i", "j", "l")]
    at_k, at_l, _ = g.dihedral_derivatives(*at, v.MOL_BOX)
    return dihedral_rows(spark, sf_dir).select("k", "i", "j", "l", *[r6(x).alias(f"at_k_{c}") for c, x in zip("xyz", at_k, strict=True)], *[r6(x).alias(f"at_l_{c}") for c, x in zip("xyz", at_l, strict=True)])


@query("p12_volume", f"WITH {S} SELECT frame_id, count(*) AS n, {q6('(1.0::DOUBLE + 0.01::DOUBLE * frame_id) * 2.0::DOUBLE * 3.0::DOUBLE')} AS volume FROM sites GROUP BY frame_id")
def p12(spark, sf_dir):
    frames = v.sites(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("n"))
    return frames.select("frame_id", "n", r6(g.volume((1.0 + 0.01 * F.col("frame_id"), F.lit(2.0), F.lit(3.0)))).alias("volume"))


_D = 2 * 0.08**2
_GAUSS = f"(exp(-r2 / {_D!r}::DOUBLE) - exp(-{0.2**2!r}::DOUBLE / {_D!r}::DOUBLE) + (2 * 0.2::DOUBLE * exp(-{0.2**2!r}::DOUBLE / {_D!r}::DOUBLE) / {_D!r}::DOUBLE) * (r - 0.2::DOUBLE)) / {_D!r}::DOUBLE"
_TANH = "-0.5::DOUBLE * tanh((r - 0.1::DOUBLE) / 0.08::DOUBLE) + 0.5::DOUBLE * tanh((0.2::DOUBLE - 0.1::DOUBLE) / 0.08::DOUBLE) + 0.5::DOUBLE / (0.08::DOUBLE * pow(cosh((0.2::DOUBLE - 0.1::DOUBLE) / 0.08::DOUBLE), 2)) * (r - 0.2::DOUBLE)"
_LUCY = "pow(0.2::DOUBLE - r, 3) * (0.2::DOUBLE + 3.0 * r) / pow(0.2::DOUBLE, 4)"
_C = kernels._polynomial(0.08, 0.2)
_POLY = f"CASE WHEN r > 0.08::DOUBLE THEN {_C[0]!r}::DOUBLE + r2 * {_C[1]!r}::DOUBLE - r2 * r2 * {_C[2]!r}::DOUBLE + r2 * r2 * r2 * {_C[3]!r}::DOUBLE ELSE 1.0 END"


@query("p13_density_kernels", f"WITH {W}, {pairs_sql()}, d AS (SELECT i, j, sqrt(r2) AS r, r2 FROM pairs) SELECT i, j, {q6(_GAUSS)} AS gaussian, {q6(_TANH)} AS switching, {q6(_LUCY)} AS lucy, {q6(_POLY)} AS relative_entropy FROM d WHERE r < 0.2::DOUBLE")
def p13(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).where(F.sqrt("r2") < CUT)
    return near.select("i", "j", *[r6(kernels.kernel(k, F.sqrt("r2"), CUT, 0.08, 0.1)).alias(k) for k in kernels.KINDS])


_AT = (0.2 - 0.1) / 0.08
_TANH_SLOPE = f"-0.5 / (0.08::DOUBLE * pow(cosh((r - 0.1::DOUBLE) / 0.08::DOUBLE), 2)) + {0.5 / (0.08 * math.cosh(_AT) ** 2)!r}::DOUBLE"
_POLY_SLOPE = f"CASE WHEN r > 0.08::DOUBLE THEN r * ({2 * _C[1]!r}::DOUBLE - 4 * r2 * {_C[2]!r}::DOUBLE + 6 * r2 * r2 * {_C[3]!r}::DOUBLE) ELSE 0 END"


@query("p14_kernel_slopes", f"WITH {W}, {pairs_sql()}, d AS (SELECT i, j, sqrt(r2) AS r, r2 FROM pairs) SELECT i, j, {q6('-12.0 * r * pow(0.2::DOUBLE - r, 2) / pow(0.2::DOUBLE, 4)')} AS lucy, {q6(f'-(2.0 * r / {_D!r}::DOUBLE) * exp(-r2 / {_D!r}::DOUBLE) + 2 * 0.2::DOUBLE * exp(-{0.2**2!r}::DOUBLE / {_D!r}::DOUBLE) / {_D!r}::DOUBLE')} AS gaussian, {q6(_TANH_SLOPE)} AS switching, {q6(_POLY_SLOPE)} AS relative_entropy FROM d WHERE r < 0.2::DOUBLE")
def p14(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).where(F.sqrt("r2") < CUT)
    return near.select("i", "j", *[r6(kernels.kernel_slope(k, F.sqrt("r2"), CUT, 0.08, 0.1)).alias(k) for k in kernels.KINDS])


HAT = "CAST(floor(least(greatest(sqrt(r2) - 0.02::DOUBLE, 0.0), 0.2::DOUBLE - 0.02::DOUBLE - 1e-14) / 0.045::DOUBLE) AS INT)"
FRAC = "least(greatest(sqrt(r2) - 0.02::DOUBLE, 0.0), 0.2::DOUBLE - 0.02::DOUBLE - 1e-14) / 0.045::DOUBLE - floor(least(greatest(sqrt(r2) - 0.02::DOUBLE, 0.0), 0.2::DOUBLE - 0.02::DOUBLE - 1e-14) / 0.045::DOUBLE)"
LO, HI, WIDTH = 0.02, 0.2, 0.045


@query("p16_hat_basis", f"WITH {W}, {pairs_sql()}, h AS (SELECT i, j, {HAT} AS b, {FRAC} AS f FROM pairs) SELECT i, j, b AS idx, {q6('1 - f')} AS val FROM h UNION ALL SELECT i, j, b + 1, {q6('f')} FROM h")
def p16(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box())
    return near.select("i", "j", F.explode(basis.hat(F.sqrt("r2"), LO, HI, WIDTH)).alias("b")).select("i", "j", "b.idx", r6("b.val").alias("val"))


_KNOTS = [float(t) for t in basis.knots(LO, HI, 7, 4)]


def recursion_sql(i: int, k: int, t: list[float] = _KNOTS) -> str:
    """The i-th B-spline of order k over knots `t` at p, in SQL, by the Cox-de Boor recursion; `span` is the knot at or before p."""
    if k == 1:
        return f"(CASE WHEN span = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    terms = ["0.0::DOUBLE"]
    if t[i + k - 1] > t[i]:
        terms.append(f"(p - {t[i]!r}::DOUBLE) / {t[i + k - 1] - t[i]!r}::DOUBLE * {recursion_sql(i, k - 1, t)}")
    if t[i + k] > t[i + 1]:
        terms.append(f"({t[i + k]!r}::DOUBLE - p) / {t[i + k] - t[i + 1]!r}::DOUBLE * {recursion_sql(i + 1, k - 1, t)}")
    return f"({' + '.join(terms)})"


def recursion_slope_sql(i: int, k: int, t: list[float] = _KNOTS) -> str:
    terms = ["0.0::DOUBLE"]
    if t[i + k - 1] > t[i]:
        terms.append(f"{recursion_sql(i, k - 1, t)} / {t[i + k - 1] - t[i]!r}::DOUBLE")
    if t[i + k] > t[i + 1]:
        terms.append(f"-{recursion_sql(i + 1, k - 1, t)} / {t[i + k] - t[i + 1]!r}::DOUBLE")
    return f"{k - 1} * ({' + '.join(terms)})"


def _spline_sql(value, sites: str = S) -> str:
    """i, j, idx, val of the four B-splines at each pair's distance; `value` gives the SQL of one."""
    spans = " + ".join(f"CASE WHEN p >= {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in _KNOTS[4:-4])
    rows = " UNION ALL ".join(f"SELECT i, j, {n} AS idx, {q6(value(n, 4))} AS val FROM placed WHERE {n} BETWEEN span - 3 AND span" for n in range(7))
    return f"WITH {sites}, {pairs_sql()}, clamped AS (SELECT i, j, least(greatest(sqrt(r2), {_KNOTS[0]!r}::DOUBLE), {_KNOTS[-1]!r}::DOUBLE) AS p FROM pairs), placed AS (SELECT *, 3 + {spans} AS span FROM clamped) {rows}"


@query("p17_bspline_basis", _spline_sql(recursion_sql, W))
def p17(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).select("i", "j", F.sqrt("r2").alias("r"))
    return basis.bspline_rows(near, F.col("r"), LO, HI, 7, 4).select("i", "j", "idx", r6("val").alias("val"))


@query("p18_bspline_slope", _spline_sql(lambda i, k: f"-({recursion_slope_sql(i, k)})", W))
def p18(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).select("i", "j", F.sqrt("r2").alias("r"))
    return basis.bspline_rows(near, F.col("r"), LO, HI, 7, 4, slope=True).select("i", "j", "idx", r6(-F.col("val")).alias("val"))


@query("p19_spline_value", f"WITH {W}, {pairs_sql()}, h AS (SELECT i, j, {HAT} AS b, {FRAC} AS f FROM pairs) SELECT i, j, {q6('(1 - f) * (1.0 / (b + 1)) + f * (1.0 / (b + 2))')} AS value FROM h")
def p19(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).select("i", "j", F.sqrt("r2").alias("r"))
    return basis.hat_value(near, F.col("r"), [1.0 / (k + 1) for k in range(6)], LO, HI, WIDTH).select("i", "j", r6("value").alias("value"))


@query("p21_clamp", f"WITH {W}, {pairs_sql()} SELECT i, j, {q6('least(greatest(sqrt(r2) - 0.05::DOUBLE, 0.0), 0.15::DOUBLE - 0.05::DOUBLE - 1e-14)')} AS inside FROM pairs")
def p21(spark, sf_dir):
    return neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).select("i", "j", r6(basis.clamp(F.sqrt("r2"), 0.05, 0.15)).alias("inside"))


@query("p22_periodic_columns", f"WITH {W}, {pairs_sql()} SELECT i, j, (({HAT} + 3) % 4)::INT AS col FROM pairs")
def p22(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box())
    first = basis.hat(F.sqrt("r2"), LO, HI, WIDTH)[0]["idx"]
    return near.select("i", "j", basis.periodic_index(first + 3, 4).cast("int").alias("col"))


@query("p23_names", f"WITH {S}, t AS (SELECT DISTINCT type_id FROM sites) SELECT a.type_id AS a, b.type_id AS b, a.type_id || '_' || b.type_id AS name, ((a.type_id - 1) * 10 + b.type_id - 1 - (a.type_id * (a.type_id - 1) // 2))::BIGINT AS number FROM t a JOIN t b ON a.type_id <= b.type_id")
def p23(spark, sf_dir):
    kinds = v.sites(spark, sf_dir).agg(F.collect_set("type_id").alias("t")).select("t", F.explode("t").alias("a"))
    both = kinds.select("a", F.explode(F.filter("t", lambda b: b >= F.col("a"))).alias("b"))
    return both.select("a", "b", keys.name([F.col("a"), F.col("b")]).alias("name"), keys.pair_number(F.col("a"), F.col("b"), 10).alias("number"))


@query("f01_range_filter", f"WITH {W}, {pairs_sql()} SELECT i, j, {q6('sqrt(r2)')} AS p FROM pairs WHERE sqrt(r2) BETWEEN 0.05::DOUBLE + 0.001::DOUBLE * least(ti, tj) AND 0.15::DOUBLE AND (least(ti, tj) + greatest(ti, tj)) % 3 <> 0")
def f01(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, whole=True), CUT, box()).withColumn("p", F.sqrt("r2"))
    t1, t2 = keys.pair_key(F.col("type_id_i"), F.col("type_id_j"))
    kinds = spark.range(1, 11).select(F.col("id").cast("int").alias("t1")).select("t1", F.explode(F.sequence("t1", F.lit(10))).alias("t2"))  # 55 rows
    specs = kinds.select("t1", "t2", (0.05 + 0.001 * F.col("t1")).alias("lo"), F.lit(0.15).alias("hi"), F.when((F.col("t1") + F.col("t2")) % 3 == 0, "none").otherwise("fm").alias("mode"))
    return parameters.in_range(near.withColumns({"t1": t1, "t2": t2}), specs, ["t1", "t2"]).select("i", "j", r6("p").alias("p"))


@query("f05_wrapping_dihedral", f"WITH {MOLS}, {BOTH}, {DIHEDRALS}, {DIHEDRAL_LEGS}, w AS (SELECT k, i, j, l, CASE WHEN p < 150 THEN p + 360 ELSE p END AS p FROM dih) SELECT k, i, j, l, {q6('p')} AS p FROM w WHERE p BETWEEN 150 AND 210")
def f05(spark, sf_dir):
    spec = spark.range(1).select(F.lit(1).alias("one"), F.lit(150.0).alias("lo"), F.lit(210.0).alias("hi"), F.lit("fm").alias("mode"), F.lit(parameters.periodic_class(150.0, 210.0)).alias("periodic"))
    rows = dihedral_rows(spark, sf_dir).withColumn("one", F.lit(1))
    return parameters.in_range(rows, spec, ["one"]).select("k", "i", "j", "l", r6("p").alias("p"))
