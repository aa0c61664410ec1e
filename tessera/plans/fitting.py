"""Queries of force matching: entries, targets, normal equations, blocks, replicas, merging and solves (A5-A19, L1-L13)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import basis
from ..operators import blocks as cells
from ..operators import neighbors, normal, parameters, solve, threebody
from ..sources import views as v
from .geometry import FRAC, HAT, HI, LO, WIDTH, box, pairs_sql
from .registry import eliminated, q6, query, r6

#: Two site types give three pair interactions; four bins each give five hat functions.
TYPES, BASES = 2, 5
COLUMNS = 3 * BASES
S2 = v.sites_sql(TYPES)
CUTOFF = 0.2
ENTRIES = f"""hats AS (SELECT *, {HAT} AS b, {FRAC} AS f, 5 * (least(ti, tj) + greatest(ti, tj) - 2) AS base FROM pairs WHERE r2 > 0),
basis AS (SELECT *, base + b AS col, 1 - f AS phi FROM hats UNION ALL SELECT *, base + b + 1, f FROM hats),
raw AS (SELECT frame_id, i AS site_id, d.dim, col, -phi * d.part / sqrt(r2) AS v FROM basis, LATERAL (VALUES (0, dx), (1, dy), (2, dz)) d(dim, part)
  UNION ALL SELECT frame_id, j, d.dim, col, phi * d.part / sqrt(r2) FROM basis, LATERAL (VALUES (0, dx), (1, dy), (2, dz)) d(dim, part)),
entries AS (SELECT frame_id, site_id, dim, col, sum(v) AS v FROM raw GROUP BY ALL),
target AS (SELECT frame_id, site_id, d.dim, d.f FROM sites, LATERAL (VALUES (0, fx), (1, fy), (2, fz)) d(dim, f))"""
FIT = f"{S2}, {pairs_sql(CUTOFF)}, {ENTRIES}, {v.WEIGHTS_SQL}"
#: The same in whole frames.
W2 = v.sites_sql(TYPES, whole=True)
WHOLE_FIT = FIT.replace(S2, W2)


def pairs(spark, sf_dir, whole: bool = False):
    return neighbors.pairs(v.sites(spark, sf_dir, TYPES, whole), CUTOFF, box()).where("r2 > 0").withColumn("first", BASES * (F.col("type_id_i") + F.col("type_id_j") - 2))


def entries(spark, sf_dir, whole: bool = False):
    if whole:
        return cells.pair_entries(v.sites(spark, sf_dir, TYPES, whole), CUTOFF, box(), TYPES, LO, HI, WIDTH)
    return normal.collected(normal.pair_entries(pairs(spark, sf_dir, whole), basis.hat(F.sqrt("r2"), LO, HI, WIDTH), F.col("first")))


def target(spark, sf_dir, whole: bool = False):
    return normal.targets(v.sites(spark, sf_dir, TYPES, whole))


def weights(spark, sf_dir, whole: bool = False):
    return v.frame_weights(v.sites(spark, sf_dir, whole=whole))


@query("a05_force_matrix", f"WITH {WHOLE_FIT} SELECT frame_id, site_id, dim, col, {q6('v')} AS v FROM entries")
def a05(spark, sf_dir):
    return entries(spark, sf_dir, whole=True).select("frame_id", "site_id", "dim", "col", r6("v").alias("v"))


@query("a06_tabulated_target", f"WITH {WHOLE_FIT}, known AS (SELECT frame_id, site_id, dim, sum(v * (0.1::DOUBLE + 0.01::DOUBLE * col)) AS k FROM entries WHERE col < 5 GROUP BY ALL) SELECT frame_id, site_id, dim, {q6('f - coalesce(k, 0)')} AS f FROM target LEFT JOIN known USING (frame_id, site_id, dim)")
def a06(spark, sf_dir):
    table = entries(spark, sf_dir, whole=True).where(f"col < {BASES}").withColumn("v", F.col("v") * (0.1 + 0.01 * F.col("col")))
    return normal.subtract_tabulated(target(spark, sf_dir, whole=True), table).select("frame_id", "site_id", "dim", r6("f").alias("f"))


@query("a07_target_square", f"WITH {S2} SELECT frame_id, count(*) * 3 AS rows, {q6('sum(fx * fx + fy * fy + fz * fz)')} AS f2 FROM sites GROUP BY frame_id")
def a07(spark, sf_dir):
    return target(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("rows"), r6(F.sum(F.col("f") * F.col("f"))).alias("f2"))


@query("a08_virial_rows", f"WITH {W2}, {pairs_sql(CUTOFF)}, hats AS (SELECT *, {HAT} AS b, {FRAC} AS f FROM pairs WHERE r2 > 0), basis AS (SELECT frame_id, r2, b AS col, 1 - f AS phi FROM hats UNION ALL SELECT frame_id, r2, b + 1, f FROM hats) SELECT frame_id, col, {q6('sum(phi * sqrt(r2))')} AS v FROM basis GROUP BY ALL")
def a08(spark, sf_dir):
    return normal.virial_entries(pairs(spark, sf_dir, whole=True), basis.hat(F.sqrt("r2"), LO, HI, WIDTH)).select("frame_id", "col", r6("v").alias("v"))


_GRAM = f"WITH {FIT}, full_rows AS (SELECT * FROM entries UNION ALL SELECT frame_id, site_id, dim, {COLUMNS}, f FROM target)"
_WHOLE_GRAM = _GRAM.replace(S2, W2)


@query("a12_normal_equations", f"{_WHOLE_GRAM} SELECT a.col::INT AS i, b.col::INT AS j, {q6('sum(weight * a.v * b.v)')} AS v FROM full_rows a JOIN full_rows b USING (frame_id, site_id, dim) JOIN weights USING (frame_id) WHERE a.col <= b.col AND weight <> 0 GROUP BY 1, 2")
def a12(spark, sf_dir):
    return normal.gram(entries(spark, sf_dir, whole=True), target(spark, sf_dir, whole=True), COLUMNS, weights(spark, sf_dir, whole=True)).select("i", "j", r6("v").alias("v"))


@query("a12_normal_equations_joined", f"WITH {WHOLE_FIT} SELECT a.col::INT AS i, b.col::INT AS j, {q6('sum(weight * a.v * b.v)')} AS v FROM entries a JOIN entries b USING (frame_id, site_id, dim) JOIN weights USING (frame_id) WHERE a.col <= b.col AND weight <> 0 GROUP BY 1, 2")
def a12_joined(spark, sf_dir):
    return normal.gram_joined(entries(spark, sf_dir, whole=True), weights(spark, sf_dir, whole=True)).select("i", "j", r6("v").alias("v"))


@query("a12_right_side", f"WITH {WHOLE_FIT} SELECT col::INT AS i, {q6('sum(weight * v * f)')} AS v FROM entries JOIN target USING (frame_id, site_id, dim) JOIN weights USING (frame_id) WHERE weight <> 0 GROUP BY 1")
def a12_right(spark, sf_dir):
    return normal.moments(entries(spark, sf_dir, whole=True), target(spark, sf_dir, whole=True), weights(spark, sf_dir, whole=True)).select("i", r6("v").alias("v"))


_REPLICAS = "replicas AS (SELECT frame_id, r::INT AS replica, ((frame_id * 7 + r * 3) % 4)::DOUBLE AS weight FROM (SELECT DISTINCT frame_id FROM sites), range(0, 3) t(r))"


def replica_weights(spark, sf_dir, whole: bool = False):
    frames = v.sites(spark, sf_dir, whole=whole).select("frame_id").distinct().withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return frames.withColumn("weight", ((F.col("frame_id") * 7 + F.col("replica") * 3) % 4).cast("double"))


@query("a13_bootstrap_equations", f"WITH {WHOLE_FIT}, {_REPLICAS} SELECT replica, a.col::INT AS i, b.col::INT AS j, {q6('sum(w.weight * a.v * b.v)')} AS v FROM entries a JOIN entries b USING (frame_id, site_id, dim) JOIN replicas w USING (frame_id) WHERE a.col <= b.col AND w.weight <> 0 GROUP BY 1, 2, 3")
def a13(spark, sf_dir):
    return normal.gram_joined(entries(spark, sf_dir, whole=True), replica_weights(spark, sf_dir, whole=True), ("replica",)).select("replica", "i", "j", r6("v").alias("v"))


@query("a14_bootstrap_weights")
def a14(spark, sf_dir):
    return normal.bootstrap_weights(v.sites(spark, sf_dir), replicas=8, draws=5)


@query("a15_tsqr")
def a15(spark, sf_dir):
    return normal.tsqr(entries(spark, sf_dir, whole=True), target(spark, sf_dir, whole=True), COLUMNS)


def blocks(spark, sf_dir, whole: bool = False):
    """Normal equations by block of one frame, with the right side as the last column."""
    e, t = entries(spark, sf_dir, whole), target(spark, sf_dir, whole)
    full = e.union(t.select("frame_id", "site_id", "dim", F.lit(COLUMNS).alias("col"), F.col("f").alias("v")))
    return normal.gram_joined(full, v.sites(spark, sf_dir, whole=whole).select("frame_id").distinct().select("frame_id", F.lit(1.0).alias("weight"), F.col("frame_id").alias("block")), ("block",))


@query("a16_block_average")
def a16(spark, sf_dir):
    return solve.block_average(solve.by_group(blocks(spark, sf_dir, whole=True), COLUMNS, "block"))


@query("a19_merge_runs", f"WITH {WHOLE_FIT}, g AS (SELECT frame_id AS run, a.col::INT AS i, b.col::INT AS j, sum(a.v * b.v) AS v FROM entries a JOIN entries b USING (frame_id, site_id, dim) WHERE a.col <= b.col GROUP BY 1, 2, 3) SELECT i, j, {q6('sum((run + 1) * v) / (SELECT sum(run + 1) FROM (SELECT DISTINCT run FROM g))')} AS v FROM g GROUP BY 1, 2")
def a19(spark, sf_dir):
    w = v.sites(spark, sf_dir, whole=True).select("frame_id").distinct().select("frame_id", F.lit(1.0).alias("weight"), F.col("frame_id").alias("run"))
    runs = normal.gram_joined(entries(spark, sf_dir, whole=True), w, ("run",)).withColumn("n", (F.col("run") + 1).cast("double"))
    return normal.merge_runs(runs).select("i", "j", r6("v").alias("v"))


@query("l01_preconditioner", f"WITH {WHOLE_FIT}, g AS (SELECT a.col::INT AS i, b.col::INT AS j, sum(a.v * b.v) AS v FROM entries a JOIN entries b USING (frame_id, site_id, dim) GROUP BY 1, 2) SELECT j, {q6('1 / sqrt(sum(v * v))')} AS h FROM g GROUP BY j")
def l01(spark, sf_dir):
    g = normal.gram_joined(entries(spark, sf_dir, whole=True))
    both = g.select(F.explode(F.array_distinct(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("p"), "v")
    return both.groupBy(F.col("p.j").alias("j")).agg(r6(1 / F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("h"))


def solved(spark, sf_dir, whole: bool = False):
    return solve.dense(normal.gram(entries(spark, sf_dir, whole), target(spark, sf_dir, whole), COLUMNS, weights(spark, sf_dir, whole)), COLUMNS)


def _frame(spark, x: np.ndarray):
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(x)], "col int, x double")  # one row for each column


_G = f"WITH RECURSIVE {FIT}, full_rows AS (SELECT * FROM entries UNION ALL SELECT frame_id, site_id, dim, {COLUMNS}, f FROM target), g AS (SELECT a.col::INT AS i, b.col::INT AS j, sum(weight * a.v * b.v) AS v FROM full_rows a JOIN full_rows b USING (frame_id, site_id, dim) JOIN weights USING (frame_id) WHERE a.col <= b.col AND weight <> 0 GROUP BY 1, 2)"
_NORMS = f"norms AS (SELECT c, sqrt(sum(v * v)) AS norm FROM (SELECT j AS c, v FROM g WHERE j < {COLUMNS} UNION ALL SELECT i, v FROM g WHERE j < {COLUMNS} AND i < j) GROUP BY c)"


@query("l02_vector_regularized", f"{_G}, {eliminated('g', COLUMNS, diagonal=f'0.01::DOUBLE + 0.09::DOUBLE / {COLUMNS - 1} * {{i}}')} SELECT col, {q6('x')} AS x FROM x")
def l02(spark, sf_dir):
    g, r, _ = solved(spark, sf_dir)
    return _frame(spark, solve.solve(g, r, diagonal=np.linspace(0.01, 0.1, COLUMNS))[0]).select("col", r6("x").alias("x"))


@query("l03_tikhonov", f"{_G}, {_NORMS}, regular AS (SELECT i, j, v + CASE WHEN i = j AND i < {COLUMNS} THEN 0.1::DOUBLE * 0.1::DOUBLE * norm ELSE 0 END AS v FROM g LEFT JOIN norms ON c = i), {eliminated('regular', COLUMNS)} SELECT col, {q6('x')} AS x FROM x")
def l03(spark, sf_dir):
    g, r, _ = solved(spark, sf_dir)
    return _frame(spark, solve.solve(g, r, ridge=0.1)[0]).select("col", r6("x").alias("x"))


_TWO = f"WITH {S2}, {pairs_sql(CUTOFF)}, p1 AS (SELECT *, sqrt(r2) AS r FROM pairs WHERE r2 > 0), b AS (SELECT *, 0 AS col, 1 - (r / 0.2::DOUBLE) AS phi FROM p1 UNION ALL SELECT *, 1, r / 0.2::DOUBLE FROM p1), raw AS (SELECT frame_id, i AS site_id, d.dim, col, -phi * d.part / r AS v FROM b, LATERAL (VALUES (0, dx), (1, dy), (2, dz)) d(dim, part) UNION ALL SELECT frame_id, j, d.dim, col, phi * d.part / r FROM b, LATERAL (VALUES (0, dx), (1, dy), (2, dz)) d(dim, part)), e AS (SELECT frame_id, site_id, dim, sum(v) FILTER (WHERE col = 0) AS a0, sum(v) FILTER (WHERE col = 1) AS a1 FROM raw GROUP BY ALL), target AS (SELECT frame_id, site_id, d.dim, d.f FROM sites, LATERAL (VALUES (0, fx), (1, fy), (2, fz)) d(dim, f)), s AS (SELECT sum(a0 * a0) AS g00, sum(a0 * a1) AS g01, sum(a1 * a1) AS g11, sum(a0 * f) AS r0, sum(a1 * f) AS r1 FROM e JOIN target USING (frame_id, site_id, dim))"
_WHOLE_TWO = _TWO.replace(S2, W2)


@query("l04_least_squares", f"{_WHOLE_TWO} SELECT 0 AS col, floor((r0 * g11 - r1 * g01) / (g00 * g11 - g01 * g01) * 1e5 + 0.5) / 1e5 AS x FROM s UNION ALL SELECT 1, floor((r1 * g00 - r0 * g01) / (g00 * g11 - g01 * g01) * 1e5 + 0.5) / 1e5 FROM s")
def l04(spark, sf_dir):
    near = neighbors.pairs(v.sites(spark, sf_dir, TYPES, whole=True), CUTOFF, box()).where("r2 > 0")
    f = F.sqrt("r2") / CUTOFF
    line = F.array(F.struct(F.lit(0).alias("idx"), (1 - f).alias("val")), F.struct(F.lit(1).alias("idx"), f.alias("val")))
    g, r, _ = solve.dense(normal.gram(normal.pair_entries(near, line), target(spark, sf_dir, whole=True), 2), 2)
    x, _ = solve.solve(g, r)
    return _frame(spark, np.floor(x * 1e5 + 0.5) / 1e5)


@query("l06_bootstrap_solve", f"WITH RECURSIVE {FIT}, {_REPLICAS}, full_rows AS (SELECT * FROM entries UNION ALL SELECT frame_id, site_id, dim, {COLUMNS}, f FROM target), g AS (SELECT replica, a.col::INT AS i, b.col::INT AS j, sum(w.weight * a.v * b.v) AS v FROM full_rows a JOIN full_rows b USING (frame_id, site_id, dim) JOIN replicas w USING (frame_id) WHERE a.col <= b.col AND w.weight <> 0 GROUP BY 1, 2, 3), {eliminated('g', COLUMNS, 'replica')} SELECT replica, col, {q6('x')} AS x FROM x")
def l06(spark, sf_dir):
    full = entries(spark, sf_dir).union(target(spark, sf_dir).select("frame_id", "site_id", "dim", F.lit(COLUMNS).alias("col"), F.col("f").alias("v")))
    triangles = normal.gram_rows(full, COLUMNS, replica_weights(spark, sf_dir), by=("replica",))
    return solve.by_group(triangles, COLUMNS, "replica").select(F.col("replica").cast("int").alias("replica"), "col", r6("x").alias("x"))


@query("l10_l_curve")
def l10(spark, sf_dir):
    got = normal.tsqr(entries(spark, sf_dir, whole=True), target(spark, sf_dir, whole=True), COLUMNS).toPandas()  # an upper triangle
    m = np.zeros((COLUMNS + 1, COLUMNS + 1))
    m[got["i"], got["j"]] = got["v"]
    return spark.createDataFrame(solve.l_curve(m[:, :COLUMNS], m[:, COLUMNS], [0.01, 0.03, 0.1, 0.3, 1.0, 3.0]))


@query("l11_residual", f"{_WHOLE_GRAM}, x AS (SELECT c.c AS col, CASE WHEN c.c = {COLUMNS} THEN -1.0::DOUBLE ELSE 0.01::DOUBLE * (c.c + 1) END AS x FROM range(0, {COLUMNS + 1}) c(c)), left_over AS (SELECT frame_id, site_id, dim, sum(v * x) AS d FROM full_rows JOIN x USING (col) GROUP BY ALL) SELECT {q6('sum(weight * d * d)')} AS residual FROM left_over JOIN weights USING (frame_id)")
def l11(spark, sf_dir):
    g = normal.gram(entries(spark, sf_dir, whole=True), target(spark, sf_dir, whole=True), COLUMNS, weights(spark, sf_dir, whole=True))
    x = spark.range(COLUMNS).select(F.col("id").cast("int").alias("i"), (0.01 * (F.col("id") + 1)).alias("x"))
    return normal.residual(g, x, COLUMNS).select(r6("residual").alias("residual"))


@query("l12_bayesian")
def l12(spark, sf_dir):
    g, r, f2 = solved(spark, sf_dir, whole=True)
    n = v.sites(spark, sf_dir, whole=True).count() * 3
    trace = solve.bayesian(g, r, f2, float(n), rounds=5)
    return spark.createDataFrame([(k, float(b.beta), float(b.residual), [float(a) for a in b.alpha], [float(c) for c in b.solution]) for k, b in enumerate(trace)], "iteration int, beta double, residual double, alpha array<double>, solution array<double>")


@query("l13_iteration", f"{_G}, {eliminated('g', COLUMNS)} SELECT col, {q6('0.8::DOUBLE * 0.5::DOUBLE * x')} AS x FROM x")
def l13(spark, sf_dir):
    g, r, _ = solved(spark, sf_dir)
    return _frame(spark, solve.increment(g, r, 0.5 * r, np.zeros(COLUMNS), step=0.8)).select("col", r6("x").alias("x"))


@query("w12_column_offsets", f"WITH {S2}, k AS (SELECT DISTINCT type_id FROM sites), spec AS (SELECT a.type_id AS t1, b.type_id AS t2, (3 + a.type_id + b.type_id)::INT AS n_basis FROM k a JOIN k b ON a.type_id <= b.type_id) SELECT t1, t2, n_basis, coalesce(sum(n_basis) OVER (ORDER BY t1, t2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_column FROM spec")
def w12(spark, sf_dir):
    kinds = v.sites(spark, sf_dir, TYPES).agg(F.collect_set("type_id").alias("t")).select("t", F.explode("t").alias("t1")).select("t1", F.explode(F.filter("t", lambda b: b >= F.col("t1"))).alias("t2"))
    return parameters.column_offsets(kinds.withColumn("n_basis", 3 + F.col("t1") + F.col("t2")), ["t1", "t2"])


_SW = f"""WITH {v.sites_sql()}, {pairs_sql(0.12)}, near AS (SELECT frame_id, i AS c, j AS o, dx, dy, dz, sqrt(r2) AS r FROM pairs UNION ALL SELECT frame_id, j, i, -dx, -dy, -dz, sqrt(r2) FROM pairs),
tri AS (SELECT a.frame_id, a.c AS centre, a.o AS k, b.o AS l, a.dx AS ux, a.dy AS uy, a.dz AS uz, b.dx AS vx, b.dy AS vy, b.dz AS vz, a.r AS r1, b.r AS r2 FROM near a JOIN near b ON a.frame_id = b.frame_id AND a.c = b.c AND a.o < b.o),
f AS (SELECT *, greatest(least((ux * vx + uy * vy + uz * vz) / (r1 * r2), 0.999999::DOUBLE), -0.999999::DOUBLE) AS c, CASE WHEN r1 < 0.12::DOUBLE THEN exp(0.05::DOUBLE / (r1 - 0.12::DOUBLE)) ELSE 0 END AS w1, CASE WHEN r2 < 0.12::DOUBLE THEN exp(0.05::DOUBLE / (r2 - 0.12::DOUBLE)) ELSE 0 END AS w2,
  CASE WHEN r1 < 0.12::DOUBLE THEN -0.05::DOUBLE / pow(r1 - 0.12::DOUBLE, 2) * exp(0.05::DOUBLE / (r1 - 0.12::DOUBLE)) ELSE 0 END AS s1, CASE WHEN r2 < 0.12::DOUBLE THEN -0.05::DOUBLE / pow(r2 - 0.12::DOUBLE, 2) * exp(0.05::DOUBLE / (r2 - 0.12::DOUBLE)) ELSE 0 END AS s2 FROM tri WHERE r1 > 0 AND r2 > 0),
parts AS (""" + " UNION ALL ".join(
    f"SELECT frame_id, k, l, centre, {n} AS dim, 2 * 4.184::DOUBLE * (c + 0.1::DOUBLE) * w1 * w2 * (c * u{a} / r1 - v{a} / r2) / r1 - 4.184::DOUBLE * (c + 0.1::DOUBLE) * (c + 0.1::DOUBLE) * s1 * w2 * u{a} / r1 AS fk, 2 * 4.184::DOUBLE * (c + 0.1::DOUBLE) * w1 * w2 * (c * v{a} / r2 - u{a} / r1) / r2 - 4.184::DOUBLE * (c + 0.1::DOUBLE) * (c + 0.1::DOUBLE) * s2 * w1 * v{a} / r2 AS fl FROM f"
    for n, a in enumerate("xyz")
) + f""") SELECT frame_id, site_id, dim, {q6("sum(v)")} AS v FROM (SELECT frame_id, k AS site_id, dim, fk AS v FROM parts UNION ALL SELECT frame_id, l, dim, fl FROM parts UNION ALL SELECT frame_id, centre, dim, -(fk + fl) FROM parts) GROUP BY 1, 2, 3"""


@query("a11_threebody_fixed", _SW.replace(v.sites_sql(), v.sites_sql(whole=True)))
def a11(spark, sf_dir):
    made = threebody.fixed_from_sites(v.sites(spark, sf_dir, whole=True), 0.12, box(), 0.05, -0.1)
    return made.select("frame_id", "site_id", "dim", r6("v").alias("v"))


@query("a11_threebody_fitted")
def a11_fitted(spark, sf_dir):
    return threebody.fitted_from_sites(v.sites(spark, sf_dir, whole=True), 0.12, box(), 0.05, 8)
