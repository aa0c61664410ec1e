"""Joins, topology, ranges, fitting and tables on small hand-made systems."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import basis
from tessera.functions import geometry as g
from tessera.operators import neighbors, normal, parameters, ranges, solve, tables, threebody, topology
from tessera.streaming import incremental

SITE = "frame_id int, site_id long, type_id int, x double, y double, z double"


def random_sites(spark, n=60, frames=2, side=4.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f, i, int(i % 3) + 1, *map(float, rng.uniform(0, side, 3))) for f in range(frames) for i in range(n)]
    return spark.createDataFrame(rows, SITE), rows


def all_pairs(rows, cutoff, side):
    out = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                d = np.array(b[3:]) - np.array(a[3:])
                d -= side * np.sign(d) * (np.abs(d) > side / 2)
                if d @ d <= cutoff**2:
                    out[a[0], a[1], b[1]] = d
    return out


@pytest.mark.parametrize("cutoff", [0.9, 1.3, 1.9])
def test_pairs_with_many_and_few_cells(spark, cutoff):
    sites, rows = random_sites(spark)
    want = all_pairs(rows, cutoff, 4.0)
    got = {(r["frame_id"], r["i"], r["j"]): (r["dx"], r["dy"], r["dz"]) for r in neighbors.pairs(sites, cutoff, (4.0,) * 3).collect()}
    assert set(got) == set(want)
    for k, d in want.items():
        assert got[k] == pytest.approx(tuple(d))
    assert neighbors.pairs(sites, cutoff, (4.0,) * 3, directed=True).count() == 2 * len(want)


def test_pair_edges(spark):
    rows = [(0, 1, 1, 0.0, 0.0, 0.0), (0, 2, 1, 9.5, 0.0, 0.0), (0, 3, 1, 2.5, 5.0, 7.5), (0, 4, 1, 5.0, 5.0, 7.5)]
    got = neighbors.pairs(spark.createDataFrame(rows, SITE), 2.5, (10.0,) * 3).collect()
    assert {(r["i"], r["j"]): round(r["dx"], 6) for r in got} == {(1, 2): -0.5, (3, 4): 2.5}
    with pytest.raises(ValueError):
        neighbors.cell_counts((4.0,) * 3, 2.1)


def test_pairs_plan_is_an_equijoin(spark):
    sites, _ = random_sites(spark)
    plan = neighbors.triples(sites, 0.9, (4.0,) * 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_triples(spark):
    sites, rows = random_sites(spark, 30, 1)
    near = all_pairs(rows, 1.2, 4.0)
    of = {}
    for _, a, b in near:
        of.setdefault(a, set()).add(b)
        of.setdefault(b, set()).add(a)
    want = {(c, k, m) for c, s in of.items() for k in s for m in s if k < m}
    assert {(r["centre"], r["k"], r["l"]) for r in neighbors.triples(sites, 1.2, (4.0,) * 3).collect()} == want


def bonds(spark, *pairs):
    return spark.createDataFrame(pairs, "i long, j long")


def test_topology_shapes(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    chain, ring, star = bonds(spark, (1, 2), (2, 3), (3, 4)), bonds(spark, (1, 2), (2, 3), (3, 4), (4, 1)), bonds(spark, (1, 2), (1, 3), (1, 4))
    assert rows(topology.angles(chain)) == [(1, 2, 3), (2, 3, 4)] and rows(topology.dihedrals(chain)) == [(1, 2, 3, 4)]
    assert len(rows(topology.angles(ring))) == 4 and len(rows(topology.dihedrals(ring))) == 4
    assert len(rows(topology.angles(star))) == 3 and rows(topology.dihedrals(star)) == []
    assert [topology.exclusions(chain, s).count() for s in (0, 2, 3, 4, 5)] == [0, 3, 5, 6, 6]
    assert rows(topology.reachable(bonds(spark, *[(i, i + 1) for i in range(1, 30)], (50, 51)))) == [(i, 1) for i in range(1, 31)] + [(50, 50), (51, 50)]


def test_closure_rounds_only_for_what_tasks_cannot_join(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    lead = list(range(400))

    def find(a):
        while lead[a] != a:
            a = lead[a]
        return a

    for a, b in edges:
        lead[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((a, find(a)) for a in {x for a, b in edges if a != b for x in (a, b)})
    got = topology.reachable(bonds(spark, *edges).repartition(7))
    assert sorted(map(tuple, got.collect())) == want  # bonds of a molecule lie in many tasks
    monkeypatch.setattr(topology, "closure", lambda *_: pytest.fail("rounds over bonds that lie together"))
    assert sorted(map(tuple, topology.reachable(bonds(spark, *edges).coalesce(1)).collect())) == want


def test_replication(spark):
    got = topology.replicate(bonds(spark, (0, 1)), 3, 2, ("i", "j"), 10)
    assert sorted(map(tuple, got.collect())) == [(10, 11), (12, 13), (14, 15)]


def test_range_rules(spark):
    p = spark.createDataFrame([(1, 1, 0.5), (1, 1, 1.5), (2, 2, 3.0)], "t1 int, t2 int, p double")
    defined = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "t1 int, t2 int")
    got = {r["t1"]: (r["lo"], r["hi"], r["mode"]) for r in ranges.finish_ranges(ranges.min_max(p, ["t1", "t2"]), defined, ["t1", "t2"], 1.0).collect()}
    assert got == {1: (0.5, 1.0, "fm"), 2: (3.0, 1.0, "none"), 3: (-1.0, -1.0, "none")}
    h = ranges.histogram(p.where("t1 = 1"), ranges.min_max(p, ["t1", "t2"]), ["t1", "t2"], 0.5)
    assert [r["n"] for r in h.where("t1 = 1").orderBy("bin").collect()] == [1, 0, 0, 0]
    assert parameters.round_range(0.277, 1.93, 0.05, 2.0) == pytest.approx((0.25, 1.95)) and parameters.round_range(0.277, 1.93, 0.05) == pytest.approx((0.25, 1.93))
    assert [parameters.periodic_class(*r) for r in ((-180, 180), (150, 210), (0, 90))] == [1, 2, 0]


def lj(r):
    return 24 * (2 / r**13 - 1 / r**7)


def fit(spark, kind):
    """Sites whose forces come from a pair function are fitted; the spline must give the function back."""
    rng = np.random.default_rng(7)
    rows, cut, side = [], 2.0, 8.0
    for f in range(6):
        x = []
        while len(x) < 60:
            y = rng.uniform(0, side, 3)
            if all(np.linalg.norm(y - z - side * np.round((y - z) / side)) > 0.95 for z in x):
                x.append(y)
        force = np.zeros((60, 3))
        for a in range(60):
            for b in range(60):
                d = x[b] - x[a]
                d -= side * np.round(d / side)
                r = np.linalg.norm(d)
                if a != b and r <= cut:
                    force[a] -= (lj(r) - lj(cut)) * d / r
        rows += [(f, i, 1, *map(float, x[i]), *map(float, force[i])) for i in range(60)]
    sites = spark.createDataFrame(rows, SITE + ", fx double, fy double, fz double")
    p = neighbors.pairs(sites, cut, (side,) * 3)
    lo, hi = 0.95, 2.0
    n = basis.n_basis(lo, hi, 0.0525, kind, 4)
    b = basis.hat(F.sqrt("r2"), lo, hi, 0.0525) if kind == "linear" else basis.bspline(lo, hi, n, 4)(F.sqrt("r2"))
    g, r, f2 = solve.dense(normal.gram(normal.pair_entries(p, b), normal.targets(sites), n, chunk=64), n)
    return sites, p, b, n, g, r, f2, lambda x, c: basis.evaluate(x, c, lo, hi, kind, 4, 0.0525)


@pytest.mark.parametrize("kind", ["linear", "bspline"])
def test_force_matching_recovers_the_force(spark, kind):
    sites, p, b, n, g, r, f2, value = fit(spark, kind)
    x, s = solve.solve(g, r)
    at = np.linspace(1.1, 1.95, 20)
    assert np.abs(value(at, x) - (lj(at) - lj(2.0))).max() < (0.25 if kind == "linear" else 0.05)
    assert solve.residual(g, r, f2, x) < 0.02 * f2 and (s > 0).all()
    if kind == "linear":
        e, t = normal.collected(normal.pair_entries(p, b)), normal.targets(sites)
        joined = normal.gram_joined(e).toPandas()
        m = np.zeros((n, n))
        m[joined["i"], joined["j"]] = joined["v"]
        assert np.triu(g) == pytest.approx(m, abs=1e-8)
        got = normal.tsqr(e, t, n).toPandas()
        q = np.zeros((n + 1, n + 1))
        q[got["i"], got["j"]] = got["v"]
        assert (q.T @ q)[:n, :n] == pytest.approx(g, abs=1e-6) and (q.T @ q)[:n, n] == pytest.approx(r, abs=1e-6)
        assert solve.filtered(q[:, :n], q[:, n]) == pytest.approx(x, abs=1e-5)
        sol = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
        assert normal.residual(normal.gram(e, t, n), sol, n).first()[0] == pytest.approx(solve.residual(g, r, f2, x), abs=1e-6)


def test_normal_equations_by_hand(spark):
    e = spark.createDataFrame([(0, 1, 0, 0, 1.0), (0, 1, 0, 1, 2.0), (0, 2, 0, 1, 3.0), (1, 1, 0, 0, 5.0)], "frame_id int, site_id long, dim int, col int, v double")
    t = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 0, 2.0), (1, 1, 0, 3.0)], "frame_id int, site_id long, dim int, f double")
    w = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.0)], "frame_id int, weight double")
    g, r, f2 = solve.dense(normal.gram(e, t, 2, w), 2)
    assert g.tolist() == [[pytest.approx(51), pytest.approx(2)], [pytest.approx(2), pytest.approx(13)]] and r.tolist() == pytest.approx([31, 8]) and f2 == pytest.approx(23)
    assert solve.solve(g, r)[0] == pytest.approx(np.linalg.solve(g, r))
    runs = spark.createDataFrame([("a", 1.0, 0, 0, 2.0), ("b", 3.0, 0, 0, 6.0), ("b", 3.0, 0, 1, 4.0)], "run string, n double, i int, j int, v double")
    assert {(x["i"], x["j"]): x["v"] for x in normal.merge_runs(runs).collect()} == {(0, 0): 5.0, (0, 1): 3.0}


def test_merged_runs_are_worked_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            made.add(len(part))
            yield part

    runs = spark.createDataFrame([(0, 1.0, 0, 0, 2.0), (1, 3.0, 0, 0, 6.0), (1, 3.0, 0, 1, 4.0)], "run long, n double, i int, j int, v double").mapInPandas(counted, "run long, n double, i int, j int, v double")
    assert {(x["i"], x["j"]): x["v"] for x in normal.merge_runs(runs).collect()} == {(0, 0): 5.0, (0, 1): 3.0}
    assert made.value == 3


def test_solver_variants():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 6))
    truth = np.array([1.0, -2.0, 0.0, 0.0, 3.0, 0.0])
    b = a @ truth + 0.01 * rng.normal(size=200)
    g, r, f2 = a.T @ a, a.T @ b, float(b @ b)
    assert solve.solve(g, r)[0] == pytest.approx(truth, abs=0.01)
    assert np.linalg.norm(solve.solve(g, r, ridge=3.0)[0]) < np.linalg.norm(truth)
    assert solve.solve(g, r, diagonal=np.full(6, 1e-9))[0] == pytest.approx(solve.solve(g, r)[0], abs=1e-6)
    trace = solve.bayesian(g, r, f2, 200.0, rounds=8)
    assert len(trace) == 9 and np.abs(trace[-1].solution[[2, 3, 5]]).max() < 5e-3 and 1 / trace[-1].beta == pytest.approx(1e-4, rel=0.5)
    curve = solve.l_curve(a, b, [0.01, 0.1, 1.0, 10.0, 100.0])
    assert curve["misfit"].is_monotonic_increasing and curve["size"].is_monotonic_decreasing
    assert solve.increment(g, r, 0 * r, truth * 0, 0.5) == pytest.approx(0.5 * solve.solve(g, r)[0])
    assert solve.filtered(a, b, 1e-6) == pytest.approx(solve.filtered(a, b), abs=1e-6)


def test_group_solves_and_errors(spark):
    rows = [(k, i, j, v) for k in (0, 1) for i, j, v in ((0, 0, 4.0), (0, 1, 1.0), (1, 1, 3.0), (0, 2, 1.0 + k), (1, 2, 2.0), (2, 2, 9.0))]
    got = solve.by_group(spark.createDataFrame(rows, "replica int, i int, j int, v double"), 2, "replica")
    want = {k: np.linalg.solve([[4, 1], [1, 3]], [1 + k, 2]) for k in (0, 1)}
    assert {(r["replica"], r["col"]): r["x"] for r in got.collect()} == pytest.approx({(k, c): want[k][c] for k in want for c in (0, 1)})
    s = spark.createDataFrame([(0, 1.0), (0, 0.0), (0, 5000.0), (0, 3.0)], "col int, x double")
    assert tuple(solve.block_average(s).first()) == (0, 2.0, 2)
    v = spark.createDataFrame([(0, x) for x in (1.0, 2.0, 4.0)], "axis int, v double")
    assert solve.standard_error(v, ["axis"]).first()["se"] == pytest.approx(np.sqrt(21 - 49 / 3) / 3)
    w = normal.bootstrap_weights(spark.range(5).selectExpr("id as frame_id"), 4, 10).groupBy("replica").agg(F.sum("weight").alias("w"))
    assert [r["w"] for r in w.collect()] == [10.0] * 4


def test_threebody_is_the_gradient(spark):
    def energy(x, cos0=-0.2, cut=2.0, gamma=0.5):
        u, v = x[0] - x[2], x[1] - x[2]
        r1, r2 = np.linalg.norm(u), np.linalg.norm(v)
        return 4.184 * (u @ v / (r1 * r2) - cos0) ** 2 * np.exp(gamma / (r1 - cut) + gamma / (r2 - cut))

    x = np.array([[1.0, 0.2, 0.1], [-0.3, 1.1, 0.4], [0.0, 0.0, 0.0]])
    row = (0, 3, 1, 2, *map(float, x[0]), *map(float, x[1]))
    t = spark.createDataFrame([row], "frame_id int, centre long, k long, l long, ux double, uy double, uz double, vx double, vy double, vz double")
    got = {(r["site_id"], r["dim"]): r["v"] for r in threebody.fixed_entries(t, 2.0, 0.5, -0.2).collect()}
    for site in range(3):
        for d in range(3):
            e = np.zeros((3, 3))
            e[site, d] = 1e-6
            assert got[site + 1, d] == pytest.approx(-(energy(x + e) - energy(x - e)) / 2e-6, rel=1e-5, abs=1e-7)


def test_fitted_threebody_compiles_and_is_the_gradient(spark, sf_dir):
    """The registered plan must run as generated code; and B-splines that add up to 1 feel the legs' factors alone."""
    from tessera.plans import registry

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = registry.queries()["a11_threebody_fitted"](spark, sf_dir)
        assert got.columns == ["frame_id", "site_id", "dim", "col", "v"] and got.count() > 0
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")

    def energy(x, cut=2.0, gamma=0.5):
        r1, r2 = np.linalg.norm(x[0] - x[2]), np.linalg.norm(x[1] - x[2])
        return np.exp(gamma / (r1 - cut) + gamma / (r2 - cut))

    x = np.array([[1.0, 0.2, 0.1], [-0.3, 1.1, 0.4], [0.0, 0.0, 0.0]])
    row = (0, 3, 1, 2, *map(float, x[0]), *map(float, x[1]))
    t = spark.createDataFrame([row], "frame_id int, centre long, k long, l long, ux double, uy double, uz double, vx double, vy double, vz double")
    theta = g.angle(g.cols("ux uy uz"), g.cols("vx vy vz"))
    made = threebody.fitted_entries(t, basis.bspline(0.0, 180.0, 8, 4)(theta), basis.bspline(0.0, 180.0, 8, 4, slope=True)(theta), 2.0, 0.5)
    total = {(r["site_id"], r["dim"]): r["v"] for r in made.groupBy("site_id", "dim").agg(F.sum("v").alias("v")).collect()}
    for site in range(3):
        for d in range(3):
            e = np.zeros((3, 3))
            e[site, d] = 1e-6
            assert total[site + 1, d] == pytest.approx(-(energy(x + e) - energy(x - e)) / 2e-6, rel=1e-4, abs=1e-7)


def test_a_sound_row_may_need_two_after_it(spark):
    t = table(spark, [1.0, 2.0, 5.0, 4.0])
    held = lambda after: [r["value"] for r in tables.repair_front(t, ["t"], after).orderBy("axis").collect()]
    assert held(1) == [7.0, 6.0, 5.0, 4.0] and held(2) == [1.0, 2.0, 5.0, 4.0]


def table(spark, values, start=0.1, width=0.1):
    return spark.createDataFrame([(1, start + k * width, float(v)) for k, v in enumerate(values)], "t int, axis double, value double")


def test_tables(spark):
    t = table(spark, [-1.0, 2.0, 5.0, 3.0, 1.0])
    vals = lambda df, c="value": [round(r[c], 6) for r in df.orderBy("axis").collect()]
    assert vals(tables.integrate(t, ["t"]), "u") == [1.0, 0.95, 0.6, 0.2, 0.0]
    assert vals(tables.repair_front(t, ["t"])) == [9.0, 7.0, 5.0, 3.0, 1.0]
    assert vals(tables.repair_back(table(spark, [1.0, -1.0, -3.0, -2.0, 4.0]), ["t"])) == [1.0, -1.0, -3.0, -5.0, -7.0]
    assert vals(tables.pad(t, ["t"], 0.1, 0.0, 0.7)) == [-1.0, -1.0, 2.0, 5.0, 3.0, 1.0, 1.0, 1.0]
    assert vals(tables.pad(t, ["t"], 0.1, 0.0, 0.6, linear=True)) == [-4.0, -1.0, 2.0, 5.0, 3.0, 1.0, -1.0]
    assert vals(tables.trim(t, 0.2, 0.3)) == [2.0, 5.0]
    wrapped = tables.wrap_axis(table(spark, range(8), 120.0, 20.0), ["t"])
    assert [r["axis"] for r in wrapped.orderBy("axis").collect()] == [-160.0, -140.0, -120.0, -100.0, 120.0, 140.0, 160.0, 180.0]
    one = tables.wrap_axis(table(spark, range(5), 120.0, 20.0), ["t"])
    assert not any(r["moved"] for r in one.collect())
    assert [r["c"] for r in tables.periodic_coefficients(spark.createDataFrame([(1, i, float(i)) for i in range(4)], "t int, idx int, c double"), ["t"], 3).orderBy("idx").collect()] == [0, 1, 2, 3, 0, 1]
    lines = [r["line"] for r in tables.lammps_lines(tables.integrate(t, ["t"]), ["t"], "bond").orderBy("line_no").collect()]
    assert lines[0] == "N 5 FP 0.0 0.0 EQ 0.500000" and lines[1] == "1 0.100000 1.000000 -1.000000"
    bond = tables.finish(table(spark, [4.0, 2.0, 0.0, -2.0, -4.0], 0.8), ["t"], "bond", 0.1, 1.5)
    assert min(vals(bond, "u")) == 0 and bond.count() == 15  # 0.1 to 1.5: the line stops a step above 0
    pair = tables.finish(t, ["t"], "nonbonded", 0.1, 1.0).orderBy("axis").collect()
    assert pair[-1]["value"] == 0 and pair[-1]["u"] == 0 and pair[0]["axis"] == pytest.approx(0.1)


def test_pairs_with_a_box_for_each_frame(spark):
    rng, rows = random.Random(8), []
    sides = {1: (3.0, 4.0, 5.0), 2: (2.4, 2.5, 7.3), 3: (2.0, 2.0, 2.0)}
    for f, box in sides.items():
        rows += [(f, k, 1 + k % 2, *[rng.random() * s for s in box], *box) for k in range(60)]
    sites = spark.createDataFrame(rows, "frame_id int, site_id int, type_id int, x double, y double, z double, lx double, ly double, lz double")
    got = {(r["frame_id"], r["i"], r["j"]): r["r2"] for r in neighbors.pairs(sites, 0.95, ("lx", "ly", "lz")).collect()}
    want = {}
    for f, i, _, *a in rows:
        for g, j, _, *b in rows:
            if f == g and i < j:
                r2 = sum(min(abs(p - q), s - abs(p - q)) ** 2 for p, q, s in zip(a, b, sides[f]))
                if r2 <= 0.95**2:
                    want[(f, i, j)] = r2
    assert got == pytest.approx(want) and len(want) > 100
    with pytest.raises(Exception, match="half the box"):
        neighbors.pairs(sites, 1.1, ("lx", "ly", "lz")).count()


def test_dihedral_and_angle_tables(spark):
    degree = 180 / math.pi
    wrapped = tables.finish(table(spark, [1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 1.0], 120.0, 20.0), ["t"], "dihedral", 20.0, 0.0).orderBy("axis").collect()
    assert [r["axis"] for r in wrapped] == [-160.0, -140.0, -120.0, 120.0, 140.0, 160.0, 180.0]
    assert sum(r["value"] for r in wrapped) == pytest.approx(16 / degree) and min(r["u"] for r in wrapped) == 0
    plain = tables.finish(table(spark, [1.0, 1.0, 1.0], -20.0, 20.0), ["t"], "dihedral", 20.0, 0.0).orderBy("axis").collect()
    assert [r["u"] for r in plain] == pytest.approx([40 / degree, 20 / degree, 0.0])
    angle = tables.finish(table(spark, [3.0, 1.0, -1.0, -3.0], 60.0, 30.0), ["t"], "angle", 30.0, 0.0).orderBy("axis").collect()
    assert [(r["axis"], r["value"]) for r in angle] == [(0.0, 5.0), (30.0, 5.0), (60.0, 3.0), (90.0, 1.0), (120.0, -1.0), (150.0, -3.0), (180.0, -3.0)]


def test_streaming_ranges_and_redelivery(spark, tmp_path):
    sites, rows = random_sites(spark, 40, 4)
    want = {(r["t1"], r["t2"]): tuple(r) for r in typed_ranges(sites).collect()}
    sites.repartition(4, "frame_id").write.partitionBy("frame_id").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(sites.schema).option("maxFilesPerTrigger", 1).option("basePath", f"{tmp_path}/in").parquet(f"{tmp_path}/in/*")
    incremental.run(stream, typed_ranges, f"{tmp_path}/parts", f"{tmp_path}/ckpt").awaitTermination()
    typed_ranges(sites.where("frame_id = 0")).limit(0).count()
    got = {(r["t1"], r["t2"]): tuple(r) for r in incremental.merged_ranges(spark, f"{tmp_path}/parts", ["t1", "t2"]).collect()}
    assert got == want
    blocks = incremental.frame_blocks(sites, 2).groupBy("block_id").count().collect()
    assert {r["block_id"]: r["count"] for r in blocks} == {0: 80, 1: 80}


def typed_ranges(sites):
    p = neighbors.pairs(sites, 0.9, (4.0,) * 3).select(F.least("type_id_i", "type_id_j").alias("t1"), F.greatest("type_id_i", "type_id_j").alias("t2"), F.sqrt("r2").alias("p"))
    return ranges.min_max(p, ["t1", "t2"])
