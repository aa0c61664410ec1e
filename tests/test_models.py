"""Large solves, density forces, modes, virial rows, replicas, factors, tables from fits, inverted splines, streamed factors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import basis, kernels
from tessera.operators import density, dispatch, inversion, large, neighbors, normal, output, solve, tables, topology
from tessera.streaming import stateful

SITE = "frame_id int, site_id long, type_id int, x double, y double, z double"


def triangle_of(spark, a, f):
    full = np.column_stack([a, f])
    g = full.T @ full
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(len(g)) for j in range(i, len(g)) if g[i, j]], "i int, j int, v double")


def solution(df, n):
    x = np.full(n, np.nan)
    for r in df.collect():
        x[r["col"]] = r["x"]
    return x


def test_conjugate_gradient_like_dense(spark):
    rng = np.random.default_rng(0)
    a, f = rng.normal(size=(60, 12)), rng.normal(size=60)
    a[:, 5] = 0  # a column that nothing touches
    t = triangle_of(spark, a, f)
    own = np.delete(a, 5, 1)
    want = np.insert(np.linalg.lstsq(own, f, rcond=None)[0], 5, 0.0)
    assert np.allclose(solution(large.conjugate_gradient(t, 12), 12), want, atol=1e-8)
    g, r, _ = solve.dense(t, 12)
    ridged, _ = solve.solve(g, r, ridge=0.3)
    assert np.allclose(solution(large.conjugate_gradient(t, 12, ridge=0.3), 12), ridged, atol=1e-8)
    extra = np.linspace(0.1, 2, 12)
    diagonal = spark.createDataFrame([(k, float(d)) for k, d in enumerate(extra)], "col int, d double")
    assert np.allclose(solution(large.conjugate_gradient(t, 12, diagonal=diagonal), 12), solve.solve(g, r, diagonal=extra)[0], atol=1e-8)
    assert np.allclose(solution(large.solution(t, 12, ridge=0.3), 12), ridged)


def test_conjugate_gradient_edges(spark):
    a = np.array([[1.0, 1.0], [2.0, 2.0]])  # singular but consistent: both columns share
    assert np.allclose(solution(large.conjugate_gradient(triangle_of(spark, a, np.array([2.0, 4.0])), 2), 2), [1, 1])
    assert np.allclose(solution(large.conjugate_gradient(triangle_of(spark, np.eye(3), np.zeros(3)), 3), 3), 0)
    empty = spark.createDataFrame([], "i int, j int, v double")
    assert np.allclose(solution(large.conjugate_gradient(empty, 4), 4), 0)
    with pytest.raises(RuntimeError, match="residual"):
        large.conjugate_gradient(triangle_of(spark, np.vander(np.linspace(0, 1, 20), 9), np.ones(20) * np.arange(20)), 9, most_rounds=2)


def test_conjugate_gradient_of_many_columns(spark):
    """20,000 columns, each touching its neighbour: a chain whose solution is known by construction."""
    n = 20_000
    x = spark.range(n).select(F.col("id").alias("i"), F.sin(F.col("id") * 0.01).alias("x"))
    band = spark.range(n).select(F.explode(F.array(F.struct(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.5).alias("v")), F.struct(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(-1.0).alias("v")))).alias("e")).select("e.*").where(f"j < {n}")
    right = large.symmetric(band).join(x.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v")).select("i", F.lit(n).cast("long").alias("j"), "v")
    found = large.solution(band.union(right), n, tolerance=1e-8)
    worst = found.join(x, found["col"] == x["i"]).agg(F.max(F.abs(found["x"] - x["x"])).alias("d"), F.count("*").alias("n")).first()
    assert worst["n"] == n and worst["d"] < 1e-6


def density_sites(spark, shift=None):
    rng = np.random.default_rng(9)
    place = rng.uniform(0, 3, (30, 3))
    if shift:
        place[shift[0], shift[1]] += shift[2]
    place %= 3
    rows = [(0, i, i % 2 + 1, *map(float, p)) for i, p in enumerate(place)]
    return spark.createDataFrame(rows, SITE)


@pytest.mark.parametrize(("kind", "spec"), [("lucy", {}), ("switching", {"sigma": 0.3, "switch": 0.7}), ("relative_entropy", {"sigma": 0.4}), ("gaussian", {"sigma": 0.5})])
def test_density_forces_are_slopes_of_an_energy(spark, kind, spec):
    """With phi = 1 + 2 rho the energy is minus the sum of rho + rho^2 over sites and group pairs; forces are minus its gradient."""
    groups = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 0.5), ("b", 1, 2.0)], "group_id string, type_id int, weight double")
    cutoff, box = 1.4, (3.0, 3.0, 3.0)
    near = lambda sites: neighbors.density_pairs(sites, groups, cutoff, box)

    def energy(sites):
        rho = near(sites).groupBy("i", "home", "other").agg(F.sum(F.col("weight") * kernels.kernel(kind, F.sqrt("r2"), cutoff, **spec)).alias("rho"))
        return -rho.agg(F.sum(F.col("rho") + F.col("rho") * F.col("rho"))).first()[0]

    phi = lambda rho: F.array(F.struct(F.lit(0).alias("idx"), (1 + 2 * rho).alias("val")))
    made = normal.collected(density.density_entries(near(density_sites(spark)), kind, cutoff, phi, consistent=True, **spec))
    force = {(r["site_id"], r["dim"]): r["v"] for r in made.collect()}
    h = 1e-5
    for site, dim in ((0, 0), (7, 1), (12, 2)):
        slope = (energy(density_sites(spark, (site, dim, h))) - energy(density_sites(spark, (site, dim, -h)))) / (2 * h)
        assert force[site, dim] == pytest.approx(-slope, rel=1e-4, abs=1e-6)
    assert abs(sum(force.values())) < 1e-9


def spec_rows(spark, modes):
    rows = [(1, m, 0.0, 2.0, 3 * k, [1.0, 0.5, 0.0] if "tab" in m else None, 0.0, 1.0) for k, m in enumerate(modes)]
    return spark.createDataFrame(rows, "t int, mode string, lo double, hi double, first_column int, `table` array<double>, table_lo double, table_width double")


def test_modes_by_hand(spark):
    """One pair along x at 0.5: basis 0.5 and 0.5, table force 0.75."""
    pair = spark.createDataFrame([(0, 1, 2, 0.25, 0.5, 0.0, 0.0, 0.5, 1)], "frame_id int, i long, j long, r2 double, dx double, dy double, dz double, p double, t int")
    hats = lambda p: basis.hat(p, 0.0, 2.0, 1.0)
    for mode, want in (("fm", {0: 0.5, 1: 0.5}), ("tab", {9: -0.75}), ("fm+tab", {0: 0.5, 1: 0.5, 9: -0.75}), ("tab+fm", {0: 0.5, 1: 0.5, 9: -0.75}), ("none", {})):
        met = dispatch.with_interactions(pair, spec_rows(spark, [mode]), ["t"])
        rows = dispatch.pair_terms(met, hats, 9, "x").collect()
        assert {r["col"]: r["v"] for r in rows if r["site_id"] == 2} == pytest.approx(want)
        assert {r["col"]: -r["v"] for r in rows if r["site_id"] == 1} == pytest.approx(want)
        virial = {r["col"]: r["v"] for r in dispatch.virial_terms(met, hats, 9).collect()}
        assert virial == pytest.approx({c: x * 0.5 for c, x in want.items()})
    with pytest.raises(Exception, match="unknown mode"):
        dispatch.with_interactions(pair, spec_rows(spark, ["fitted"]), ["t"]).collect()
    assert dispatch.with_interactions(pair.withColumn("p", F.lit(2.5)), spec_rows(spark, ["fm"]), ["t"]).count() == 0


def test_table_force_ends(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (0.25,), (1.0,), (7.0,)], "p double")
    got = [r[0] for r in rows.select(dispatch.table_force(F.col("p"), F.array(*map(F.lit, [4.0, 2.0, 1.0])), F.lit(0.0), F.lit(0.5))).collect()]
    assert got == [4.0, 4.0, 3.0, 1.0, 1.0]
    assert rows.select(dispatch.table_force(F.col("p"), F.array(F.lit(4.0)), F.lit(0.0), F.lit(0.5))).distinct().collect()[0][0] == 4.0


def test_virial_rows_move_the_fit(spark):
    """A heavy frame row makes the fit meet the virial; weight 0 leaves the forces' fit."""
    forces = spark.createDataFrame([(0, s, 0, 0, 1.0) for s in range(4)], "frame_id int, site_id long, dim int, col int, v double")
    target = spark.createDataFrame([(0, s, 0, 2.0) for s in range(4)], "frame_id int, site_id long, dim int, f double")
    virial = spark.createDataFrame([(0, 0, 3.0)], "frame_id int, col int, v double")
    wanted = spark.createDataFrame([(0, 15.0)], "frame_id int, virial double")
    for weight, x in ((0.0, 2.0), (1.0, (4 * 2 + 3 * 15) / (4 + 9)), (1e12, 5.0)):
        rows = dispatch.system(forces, target, 1, virial, wanted, weight)
        assert solution(large.solution(normal.gram_rows(rows, 1), 1), 1)[0] == pytest.approx(x)


def test_frame_ranks_and_draws(spark):
    frames = spark.range(57).select((F.col("id") * 3 + 5).cast("int").alias("frame_id")).repartition(6)
    ranks, n = normal.frame_ranks(frames.union(frames))
    assert n == 57 and {r["frame_id"]: r["k"] for r in ranks.collect()} == {3 * k + 5: k for k in range(57)}
    got = {(r["replica"], r["frame_id"]): r["weight"] for r in normal.bootstrap_weights(frames, 3, 40, draw=F.col("replica") * 7 + F.col("draw") * 5).collect()}
    want: dict = {}
    for r in range(3):
        for d in range(40):
            at = (r, 3 * ((r * 7 + d * 5) % 57) + 5)
            want[at] = want.get(at, 0.0) + 1
    assert got == want
    hashed = normal.bootstrap_weights(frames, 5, 40, seed=3).groupBy("replica").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in hashed] == [40.0] * 5
    assert normal.bootstrap_weights(frames.where("false"), 2, 3).count() == 0


def test_gram_by_groups_like_the_join(spark):
    rng = np.random.default_rng(4)
    rows = [(f, s, d, int(c), float(rng.normal())) for f in range(5) for s in range(7) for d in range(2) for c in rng.choice(4, 3, replace=False)]
    entries = spark.createDataFrame(rows, "frame_id int, site_id long, dim int, col int, v double")
    weights = spark.createDataFrame([(f, float(f % 3), r, f // 2) for f in range(5) for r in range(2)], "frame_id int, weight double, replica long, block long")
    key = lambda r: (r["replica"], r["block"], r["i"], r["j"])
    got = {key(r): r["v"] for r in normal.gram_rows(entries, 3, weights, by=("replica", "block"), chunk=3).collect()}
    want = {key(r): r["v"] for r in normal.gram_joined(entries, weights, ("replica", "block")).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_factor_of_dependent_columns(spark):
    """Column 2 repeats column 0: rank 2, and the two share their coefficient."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 2))
    a = np.column_stack([a, a[:, 0]])
    f = a @ [1.0, -2.0, 3.0]
    entries = spark.createDataFrame([(0, k, 0, c, float(a[k, c])) for k in range(40) for c in range(3)], "frame_id int, site_id long, dim int, col int, v double")
    target = spark.createDataFrame([(0, k, 0, float(f[k])) for k in range(40)], "frame_id int, site_id long, dim int, f double")
    x, s, left = solve.from_factor(normal.tsqr(entries, target, 3), 3)
    assert np.allclose(x, [2.0, -2.0, 2.0]) and left < 1e-18
    assert np.allclose(np.sort(s), np.sort(np.linalg.svd(a, compute_uv=False)), atol=1e-9) and (s > 1e-9).sum() == 2


def test_splines_of_many_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(float(lo), float(lo + w), float(p)) for lo, w in ((0.2, 1.0), (-3.0, 7.0)) for p in [lo, lo + w, lo - 1, lo + w + 1, *rng.uniform(lo, lo + w, 20)]]
    df = spark.createDataFrame(rows, "lo double, hi double, p double")
    for order, n in ((4, 7), (3, 3), (6, 9)):
        for slope in (False, True):
            made = basis.bspline_between(n, order, slope)
            for r in df.withColumn("b", made(F.col("p"), F.col("lo"), F.col("hi"))).collect():
                t = basis.knots(r["lo"], r["hi"], n, order)
                first, vals = (basis.bspline_slopes if slope else basis.bspline_values)(np.array([r["p"]]), t, order)
                assert [e["idx"] for e in r["b"]] == list(range(first[0], first[0] + order))
                assert [e["val"] for e in r["b"]] == pytest.approx(vals[0], abs=1e-7)
    assert df.select(basis.bspline_between(5, 4)(F.lit(None).cast("double"), F.col("lo"), F.col("hi")).isNull()).distinct().collect()[0][0]


@pytest.mark.parametrize("model", [output.ClassModel("bond", "linear", 0.05, cutoff=2.0, width=0.5), output.ClassModel("bond", "bspline", 0.05, cutoff=2.0, n_coef=6, order=4)])
def test_tables_from_coefficients(spark, model):
    specs = spark.createDataFrame([("a", 0.5, 1.5, 0, 3 if model.spline == "linear" else 6), ("b", 0.0, 1.0, 6, 3 if model.spline == "linear" else 6)], "t string, lo double, hi double, first_column int, n_basis int")
    x = spark.createDataFrame([(k, float(np.sin(k))) for k in range(12)], "col int, x double")
    coefficients = output.interaction_coefficients(x, specs, ["t"], model)
    rows = output.force_table(specs, coefficients, ["t"], model).collect()
    for t, lo, hi, first in (("a", 0.5, 1.5, 0), ("b", 0.0, 1.0, 6)):
        own = sorted((r["axis"], r["value"]) for r in rows if r["t"] == t)
        c = np.sin(np.arange(first, first + (3 if model.spline == "linear" else 6)))
        want = basis.evaluate(np.array([p for p, _ in own]), c, lo, hi, model.spline, model.order, model.width or None)
        assert len(own) == 21 and [v for _, v in own] == pytest.approx(want, abs=1e-6)
    both = output.potential_table(specs, coefficients, ["t"], model).where("t = 'a'").orderBy("axis").collect()
    u, f, axis = (np.array([r[c] for r in both]) for c in ("u", "value", "axis"))
    middle = np.arange(1, len(u) - 1)
    bend = (u[2:] - u[:-2]) / (axis[2:] - axis[:-2])
    inside = np.abs((axis[middle] - 0.5) % 0.5) > 0.06 if model.spline == "linear" else np.full(len(middle), True)
    assert np.allclose(-f[middle][inside], bend[inside], atol=6e-2)  # steps of 0.05
    lines = output.table_lines([(output.finished(specs, coefficients, ["t"], model), model)], ["t"]).collect()
    assert {r["kind"] for r in lines} == {"bond"} and {r["t"] for r in lines if r["line"].startswith("N ")} == {"a", "b"}


def test_lines_as_files(spark, tmp_path):
    table = spark.createDataFrame([("a", k * 0.1, 1.0 - k * 0.1, 0.5) for k in range(30)] + [("b", 0.1, 2.0, 0.0)], "t string, axis double, value double, u double")
    model = output.ClassModel("nonbonded", "linear", 0.1, width=0.1)
    output.write_lines(output.table_lines([(table, model)], ["t"]), ["t"], str(tmp_path / "out"))
    (part,) = list((tmp_path / "out" / "kind=nonbonded" / "table=a").glob("part-*"))
    got = part.read_text().splitlines()
    assert got[0].startswith("N 30 R") and [int(x.split()[0]) for x in got[1:]] == list(range(1, 31))


def test_known_tables_are_added(spark):
    specs = spark.createDataFrame([("a", 0.5, 1.0, 0, 2)], "t string, lo double, hi double, first_column int, n_basis int")
    model = output.ClassModel("nonbonded", "linear", 0.1, cutoff=1.0, width=0.5)
    c = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0)], "t string, idx int, c double")
    plain = {round(r["axis"], 6): r["value"] for r in output.force_table(specs, c, ["t"], model).collect()}
    known = spark.createDataFrame([("a", 0.7, 10.0)], "t string, axis double, value double")
    done = {round(r["axis"], 6): r["value"] for r in output.finished(specs, c, ["t"], model, known).collect()}
    assert done[0.7] == pytest.approx(plain[0.7] + 10) and done[0.8] == pytest.approx(plain[0.8]) and done[1.0] == 0


def test_replica_tables(spark):
    specs = spark.createDataFrame([("a", 0.0, 1.0)], "t string, lo double, hi double")
    model = output.ClassModel("nonbonded", "linear", 0.5, width=1.0)
    c = spark.createDataFrame([(r, "a", k, v) for r, v in ((-1, 1.0), (0, 3.0), (1, 5.0)) for k in range(2)], "replica long, t string, idx int, c double")
    every, error = output.replica_tables(specs, c, ["t"], model)
    assert every.count() == 9
    for r in error.collect():
        assert r["value"] == pytest.approx(1.0) and r["se"] == pytest.approx(math.sqrt(35 - 81 / 3) / 3)


def test_inverted_spline_fit(spark):
    rng = np.random.default_rng(8)
    rows = [(t, k, 0.2 + 0.1 * k + 0.01 * t, float(rng.normal())) for t, n in ((1, 12), (2, 30), (3, 2)) for k in range(n)]
    bins = spark.createDataFrame(rows, "t int, bin int, centre double, u double")
    bins = bins.join(bins.groupBy("t").agg(F.min("centre").alias("lo"), F.max("centre").alias("hi")), "t")
    spline = basis.bspline_between(6, 4)
    got: dict = {}
    for r in inversion.fit(bins, ["t"], lambda p: spline(p, F.col("lo"), F.col("hi")), 6).collect():
        got.setdefault(r["t"], np.zeros(6))[r["idx"]] = r["c"]
    for t in (1, 2, 3):
        p, u = np.array([r[2] for r in rows if r[0] == t]), np.array([r[3] for r in rows if r[0] == t])
        first, vals = basis.bspline_values(p, basis.knots(p.min(), p.max(), 6, 4), 4)
        a = np.zeros((len(p), 6))
        for k in range(len(p)):
            a[k, first[k] : first[k] + 4] = vals[k]
        want = np.linalg.lstsq(a, u, rcond=None)[0]
        assert np.allclose(a @ got[t], a @ want, atol=1e-5)
    spec = spark.createDataFrame([("nonbonded", "fm", 5), ("bond", "tab", 3)], "class string, mode string, n_basis int")
    assert {(r["class"], r["mode"], r["n_basis"]) for r in inversion.screened(spec, ["nonbonded"]).collect()} == {("nonbonded", "fm", 5), ("bond", "none", 0)}


def stream_rows(rng, frames, n=3):
    return [(f % 2, f, s, 0, c, float(rng.normal()), [1.0 + f, 2.0, 3.0]) for f in frames for s in range(5) for c in range(n + 1)]


ROWS = "run long, frame_id long, site_id long, dim int, col int, v double, box array<double>"


def test_streamed_factor_restarts_and_takes_frames_once(spark, tmp_path):
    rng = np.random.default_rng(11)
    batches = [stream_rows(rng, fs) for fs in ((3, 0), (9, 4, 1), (2,))]
    again = [(*r[:5], r[5] + 1.0, r[6]) for r in batches[0][:20]]  # a frame delivered anew, with other values
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for number, rows in enumerate([batches[0], batches[1] + again, batches[2]]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        stateful.run_factors(stream, 3, out, state, shards=3).awaitTermination()  # each time the query starts anew
        seen = {f for b in batches[: number + 1] for _, f, *_ in b}
        states = {r["run"]: (r["frames"], r["last_frame"], r["box"][0]) for r in stateful.run_states(spark, out).collect()}
        assert states == {run: (len([f for f in seen if f % 2 == run]), max(f for f in seen if f % 2 == run), 1.0 + max(f for f in seen if f % 2 == run)) for run in {f % 2 for f in seen}}
    got = {(r["run"], r["i"], r["j"]): r["v"] for r in stateful.merged_triangle(spark, out, 3).collect()}
    for run in (0, 1):
        cells = [r for b in batches for r in b if r[0] == run]
        keys = sorted({(r[1], r[2]) for r in cells})
        m = np.zeros((len(keys), 4))
        for r in cells:
            m[keys.index((r[1], r[2])), r[4]] += r[5]
        g = m.T @ m
        assert all(got[run, i, j] == pytest.approx(g[i, j]) for i in range(4) for j in range(i, 4))


def test_finished_dihedral_uses_tables(spark):
    """Periodic coefficients are repeated before the spline is evaluated."""
    specs = spark.createDataFrame([("a", -180.0, 180.0, 0, 4)], "t string, lo double, hi double, first_column int, n_basis int")
    model = output.ClassModel("dihedral", "bspline", 10.0, n_coef=7, order=4, periodic=True)
    x = spark.createDataFrame([(k, float(k)) for k in range(4)], "col int, x double")
    c = output.interaction_coefficients(x, specs, ["t"], model)
    assert [r["c"] for r in c.orderBy("idx").collect()] == [0.0, 1.0, 2.0, 3.0, 0.0, 1.0, 2.0]
    done = output.finished(specs, c, ["t"], model)
    assert done.agg(F.min("u")).first()[0] == pytest.approx(0.0) and tables.trim(done, -180.0, 180.0).count() == done.count()


def test_pairs_outside_molecules(spark):
    """Leaving molecules out by two joins is leaving out every pair that bonds reach."""
    rng = np.random.default_rng(12)
    sites = spark.createDataFrame([(f, i, 1, *map(float, rng.uniform(0, 4, 3))) for f in range(2) for i in range(40)], SITE)
    bonds = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 7 != 6] + [(33, 31)], "i long, j long")
    near = neighbors.pairs(sites, 1.5, (4.0,) * 3)
    key = lambda df: {(r["frame_id"], r["i"], r["j"]) for r in df.collect()}
    got = key(neighbors.outside_molecules(near, topology.reachable(bonds)))
    assert got == key(neighbors.without_excluded(near, topology.exclusions(bonds, 5))) and got < key(near)
    assert key(neighbors.outside_molecules(near, topology.reachable(bonds).where("false"))) == key(near)


def test_triples_and_densities_in_boxes_by_frame(spark):
    """Frames with boxes of their own give what each gives alone in its box."""
    rng = np.random.default_rng(13)
    boxes = {0: (4.0, 4.0, 4.0), 1: (5.0, 4.5, 6.0)}
    rows = [(f, i, i % 2 + 1, *(float(x) for x in rng.uniform(0, 1, 3) * boxes[f]), *boxes[f]) for f in boxes for i in range(25)]
    sites = spark.createDataFrame(rows, SITE + ", lx double, ly double, lz double")
    groups = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 0.5)], "group_id string, type_id int, weight double")
    rounded = lambda df, cols: sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())
    names = ["frame_id", "centre", "k", "l", "ux", "vz"]
    alone = [neighbors.triples(sites.where(f"frame_id = {f}"), 1.4, boxes[f]) for f in boxes]
    assert rounded(neighbors.triples(sites, 1.4, ("lx", "ly", "lz")), names) == sorted(rounded(alone[0], names) + rounded(alone[1], names))
    names = ["frame_id", "i", "j", "home", "other", "r2"]
    alone = [neighbors.density_pairs(sites.where(f"frame_id = {f}"), groups, 1.4, boxes[f]) for f in boxes]
    assert rounded(neighbors.density_pairs(sites, groups, 1.4, ("lx", "ly", "lz")), names) == sorted(rounded(alone[0], names) + rounded(alone[1], names))
