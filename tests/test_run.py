"""A whole run on a made-up model: forces from known functions come back as their tables."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import run
from tessera.config import DEGREES_PER_RADIAN, Control
from tessera.operators import large
from tessera.sources import model

TOP = "cgsites 32\ncgtypes 2\nA\nB\nmoltypes 2\nmol 4 3\nsitetypes\nA\nB\nB\nA\nbonds 3\n1 2\n2 3\n3 4\nmol 2 1\nsitetypes\nA\nA\nbonds 1\n1 2\nsystem 2\n1 6\n2 4\n"
CONTROL = Control(n_frames=4, block_size=1, basis_type="linear", nonbonded_cutoff=1.9, exclusion_style=4, nonbonded_bin_width=0.95, bond_bin_width=2.0, angle_bin_width=90.0, dihedral_bin_width=180.0, nonbonded_output_width=0.1, bond_output_width=0.1, angle_output_width=10.0, dihedral_output_width=10.0)
#: Forces along the parameters: straight lines, so that two or three hat functions hold them exactly.
PAIR = {(1, 1): lambda r: 3 - r, (1, 2): lambda r: 2 - 0.5 * r, (2, 2): lambda r: 4 - 2 * r}
BOND, ANGLE, DIHEDRAL = (lambda r: 1.5 - r), (lambda t: 0.04 - 0.0003 * t), (lambda p: 0.2 + 0.001 * abs(p))


def nearest(d, side):
    return d - side * np.round(d / side)


def angle(a, c, b, side):
    u, v = nearest(a - c, side), nearest(b - c, side)
    return math.degrees(math.acos(u @ v / np.linalg.norm(u) / np.linalg.norm(v)))


def dihedral(k, i, j, end, side):
    e, m, n = nearest(i - k, side), nearest(j - i, side), nearest(end - j, side)
    p, q = np.cross(e, m), np.cross(m, n)
    size = math.degrees(math.acos(np.clip(p @ q / np.linalg.norm(p) / np.linalg.norm(q), -1, 1)))
    return -size if p @ n < 0 else size


def push(force, x, sites, value, phi):
    """Adds phi times the numerical slope of a parameter at each of its sites."""
    for s in sites:
        for d in range(3):
            h = np.zeros_like(x)
            h[s, d] = 1e-5
            force[s, d] += phi * (value(x + h) - value(x - h)) / 2e-5


@pytest.fixture(scope="module")
def made(spark):
    """(trajectory, molecules' paths): six chains of four sites and four pairs, in boxes that change from frame to frame."""
    rng = np.random.default_rng(5)
    chains = [[4 * k + s for s in range(4)] for k in range(6)] + [[24 + 2 * k, 25 + 2 * k] for k in range(4)]
    kinds = [1, 2, 2, 1] * 6 + [1, 1] * 4
    rows, excluded = [], {(min(a, b), max(a, b)) for c in chains for a in c for b in c if a != b}
    for frame in range(1, 5):
        side = np.array([6.0, 6.5, 7.0]) + 0.1 * frame
        x = np.zeros((32, 3))
        for c in chains:
            x[c[0]] = rng.uniform(0, 6, 3)
            for a, b in zip(c, c[1:], strict=False):
                step = rng.normal(size=3)
                x[b] = x[a] + step / np.linalg.norm(step) * rng.uniform(0.8, 1.2)
        x = np.mod(x, side)
        force = np.zeros_like(x)
        for a in range(32):
            for b in range(a + 1, 32):
                d = nearest(x[b] - x[a], side)
                r = np.linalg.norm(d)
                if (a, b) not in excluded and r <= 1.9:
                    f = PAIR[tuple(sorted((kinds[a], kinds[b])))](r) * d / r
                    force[a] -= f
                    force[b] += f
        for c in chains:
            for a, b in zip(c, c[1:], strict=False):
                d = nearest(x[b] - x[a], side)
                f = BOND(np.linalg.norm(d)) * d / np.linalg.norm(d)
                force[a] -= f
                force[b] += f
            for k in range(len(c) - 2):
                a, m, b = c[k : k + 3]
                push(force, x, (a, m, b), lambda y, a=a, m=m, b=b, side=side: angle(y[a], y[m], y[b], side), ANGLE(angle(x[a], x[m], x[b], side)))
            if len(c) == 4:
                value = lambda y, c=c, side=side: dihedral(*[y[s] for s in c], side)
                push(force, x, c, value, DIHEDRAL(value(x)) / DEGREES_PER_RADIAN)  # a force per radian on slopes in degrees
        rows += [(frame, s, kinds[s], *map(float, x[s]), *map(float, force[s]), *map(float, side)) for s in range(32)]
    return spark.createDataFrame(rows, "frame_id int, site_id long, type_id int, x double, y double, z double, fx double, fy double, fz double, lx double, ly double, lz double"), chains


def listed(mode="fm"):
    pair = [{"types": list(t), "lo": 0.0, "hi": 1.9, "mode": mode if t == (1, 2) else "fm"} for t in PAIR]
    bond = [{"types": t, "lo": 0.0, "hi": 2.0, "mode": "fm"} for t in ([1, 1], [1, 2], [2, 2])]
    return {"nonbonded": pair, "bond": bond, "angle": [{"types": [2, 1, 2], "lo": 0.0, "hi": 180.0, "mode": "fm"}], "dihedral": [{"types": [2, 2, 1, 1], "lo": -180.0, "hi": 180.0, "mode": "fm"}]}


def test_a_run_finds_the_forces_that_made_it(spark, made):
    system = run.load(spark, CONTROL, model.parse_topology(TOP), made[0])
    interactions, n = run.plan(CONTROL, listed())
    assert n == 3 * 3 + 3 * 2 + 3 + 2
    fit = run.match_forces(spark, system, interactions, n)
    f2 = made[0].agg(F.sum(F.col("fx") ** 2 + F.col("fy") ** 2 + F.col("fz") ** 2)).first()[0]
    assert run.residual(fit) < 1e-6 * f2
    x = {r["col"]: r["x"] for r in fit.solution.collect()}
    for row in interactions["nonbonded"].rows:
        want = PAIR[row[:2]]
        assert [x[row[5] + k] for k in (1, 2)] == pytest.approx([want(0.95), want(1.9)], abs=1e-4)
    for row in interactions["bond"].rows:
        assert [x[row[5] + k] for k in range(2)] == pytest.approx([1.5, -0.5], abs=1e-3)
    (row,) = interactions["angle"].rows
    assert [x[row[6] + k] for k in range(3)] == pytest.approx([ANGLE(t) for t in (0, 90, 180)], abs=1e-5)
    (row,) = interactions["dihedral"].rows
    assert [x[row[7] + k] for k in range(2)] == pytest.approx([DIHEDRAL(180), DIHEDRAL(0)], abs=1e-5)
    tables = run.fitted_tables(spark, fit)
    assert set(tables) == {"nonbonded", "bond", "angle", "dihedral"}
    got = {round(r["axis"], 6): r["value"] for r in tables["nonbonded"].where("t1 = 1 and t2 = 2").collect()}
    assert got[1.0] == pytest.approx(PAIR[1, 2](1.0), abs=1e-4) and got[1.9] == 0
    per_degree = {round(r["axis"], 6): r["value"] for r in tables["dihedral"].collect()}
    assert per_degree[90.0] == pytest.approx(DIHEDRAL(90) / DEGREES_PER_RADIAN, abs=1e-6)
    lines = run.fitted_lines(spark, fit).collect()
    assert {(r["kind"], r["types"]) for r in lines} == {("nonbonded", "1_1"), ("nonbonded", "1_2"), ("nonbonded", "2_2"), ("bond", "1_1"), ("bond", "1_2"), ("bond", "2_2"), ("angle", "2_1_2"), ("dihedral", "2_2_1_1")}


def test_tabulated_and_mixed_interactions_of_a_run(spark, made):
    """With the 1-2 pairs' force known in half or in whole, the fit finds what is left; the written table is their sum."""
    system = run.load(spark, CONTROL, model.parse_topology(TOP), made[0])
    table = lambda share: [{"class": "nonbonded", "types": [1, 2], "lo": 0.0, "hi": 2.0, "binwidth": 1.0, "values": [share * PAIR[1, 2](r) for r in (0.0, 1.0, 2.0)]}]
    interactions, n = run.plan(CONTROL, listed("tab"), table(1.0))
    assert n == 2 * 3 + 3 * 2 + 3 + 2 and run.residual(run.match_forces(spark, system, interactions, n)) < 1e-4
    interactions, n = run.plan(CONTROL, listed("fm+tab"), table(0.5))
    fit = run.match_forces(spark, system, interactions, n)
    x = {r["col"]: r["x"] for r in fit.solution.collect()}
    row = next(r for r in interactions["nonbonded"].rows if r[:2] == (1, 2))
    assert [x[row[5] + k] for k in (1, 2)] == pytest.approx([0.5 * PAIR[1, 2](p) for p in (0.95, 1.9)], abs=1e-4)
    got = {round(r["axis"], 6): r["value"] for r in run.fitted_tables(spark, fit)["nonbonded"].where("t1 = 1 and t2 = 2").collect()}
    assert got[1.0] == pytest.approx(PAIR[1, 2](1.0), abs=1e-4)


def test_ranges_of_a_run(spark, made):
    system = run.load(spark, CONTROL, model.parse_topology(TOP), made[0])
    found = run.find_ranges(system)
    assert {(r["t1"], r["t2"]) for r in found["nonbonded"].collect()} == set(PAIR) and found["nonbonded"].where("mode <> 'fm' or hi > 1.9").count() == 0
    bonds = found["bond"].collect()
    assert sum(r["n"] for r in bonds) == 4 * (6 * 3 + 4) and all(0.8 <= r["lo"] <= r["hi"] <= 1.2 for r in bonds)
    assert found["angle"].first()["n"] == 4 * 12 and found["dihedral"].first()["n"] == 4 * 6
    fine = dataclasses.replace(system, control=dataclasses.replace(CONTROL, bond_bin_width=0.05))
    counts = run.distributions(fine, ("bond",))["bond"]
    assert 60 < counts.agg(F.sum("n")).first()[0] <= 4 * 22


def test_frames_weights_and_splines_of_a_run(spark, made):
    """Two frames only, weights that leave one of them, and B-splines of different lengths side by side."""
    replace = dataclasses.replace
    control = replace(CONTROL, n_frames=2, start_frame=2, basis_type="bspline", nonbonded_bin_width=0.5, bond_bin_width=0.5, bond_order=3, use_frame_weights=1)
    system = run.load(spark, control, model.parse_topology(TOP), made[0])
    assert {r["frame_id"] for r in system.sites.select("frame_id").distinct().collect()} == {2, 3}
    rows = {"nonbonded": [{"types": [1, 1], "lo": 0.0, "hi": 1.9, "mode": "fm"}, {"types": [1, 2], "lo": 0.5, "hi": 1.9, "mode": "fm"}], "bond": [{"types": [1, 2], "lo": 0.5, "hi": 1.5, "mode": "fm"}]}
    interactions, n = run.plan(control, rows)
    assert interactions["nonbonded"].sizes() == [6, 7] and n == 7 + 6 + 4
    weights = spark.createDataFrame([(2, 1.0), (3, 0.0)], "frame_id int, weight double")
    fit = run.match_forces(spark, system, interactions, n, weights)
    one = run.load(spark, replace(control, n_frames=1, use_frame_weights=0), model.parse_topology(TOP), made[0])
    other = run.match_forces(spark, one, interactions, n)
    left, right = ({(r["i"], r["j"]): r["v"] for r in f.triangle.collect()} for f in (fit, other))
    assert set(left) == set(right) and all(left[k] == pytest.approx(right[k]) for k in left)
    axes = {t: {round(r["axis"], 6) for r in run.fitted_tables(spark, fit)["nonbonded"].where(f"t1 = 1 and t2 = {t}").collect()} for t in (1, 2)}
    assert axes[1] >= axes[2] and {round(0.1 * k, 6) for k in range(1, 20)} <= axes[1]


def test_plans_that_cannot_be(spark):
    with pytest.raises(ValueError, match="no table"):
        run.plan(CONTROL, listed("tab"))
    with pytest.raises(ValueError, match="twice"):
        run.plan(CONTROL, {"bond": [{"types": [1, 2], "lo": 0.0, "hi": 2.0, "mode": "fm"}, {"types": [2, 1], "lo": 0.0, "hi": 2.0, "mode": "fm"}]})
    with pytest.raises(ValueError, match="shorter"):
        run.plan(CONTROL, {"bond": [{"types": [1, 2], "lo": 0.0, "hi": 0.5, "mode": "fm"}]})
    assert large.solution(spark.createDataFrame([], "i int, j int, v double"), 0).count() == 0
