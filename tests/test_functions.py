"""Geometry, kernels, keys and bases: hand-made cases and finite differences."""

import dataclasses
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import KEYS, Control, parse_control
from tessera.functions import basis, kernels, keys
from tessera.functions import geometry as g


def values(spark, rows, names, **exprs):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names.split()))
    return df.select(*[e.alias(k) for k, e in exprs.items()]).collect()


def test_wrap_and_image(spark):
    got = values(spark, [(-0.5,), (10.0,), (23.0,), (9.999,)], "x", w=g.wrap(F.col("x"), 10.0))
    assert [r["w"] for r in got] == pytest.approx([9.5, 0.0, 3.0, 9.999])
    got = values(spark, [(9.0,), (-9.0,), (5.0,), (5.1,)], "d", d=g.min_image(F.col("d"), 10.0))
    assert [r["d"] for r in got] == pytest.approx([-1.0, 1.0, 5.0, -4.9])


def test_rounding_of_what_a_long_cannot_hold(spark):
    import duckdb

    from tessera.plans.registry import q6, r6

    rows = [1.2345678, -1.2345675, 0.0078125, 9.3e12, -1.3025221076292738e14, 3.661181160164673e17, -4e30, 9007199254.740992, math.nan]
    got = [r["v"] for r in values(spark, [(x,) for x in rows], "x", v=r6("x"))]
    want = [duckdb.execute(f"SELECT {q6('x')} FROM (SELECT ?::DOUBLE AS x)", [x]).fetchone()[0] for x in rows]
    assert got[:-1] == want[:-1] and math.isnan(got[-1]) and math.isnan(want[-1])


def test_angles(spark):
    got = values(spark, [(1, 0, 0, 0, 2, 0), (1, 0, 0, -3, 0, 0), (0, 0, 0, 1, 0, 0)], "ux uy uz vx vy vz", a=g.angle(g.cols("ux uy uz"), g.cols("vx vy vz")))
    assert got[0]["a"] == pytest.approx(90) and got[1]["a"] == pytest.approx(180, abs=0.1) and got[2]["a"] is None


def test_dihedral_gradients_in_radians_are_not_turned_twice(spark):
    rng = np.random.default_rng(3)
    rows = rng.uniform(-1, 1, (100, 12)).round(2)
    k, i, j, end = (g.cols(" ".join(f"{c}{a}" for a in "xyz")) for c in "kijl")
    got = [r["v"] for r in values(spark, rows, "kx ky kz ix iy iz jx jy jz lx ly lz", v=g.dihedral_derivatives(k, i, j, end, radians=True)[0][0])]
    for row, v in zip(rows, got, strict=True):
        a, b = row[3:6] - row[0:3], row[6:9] - row[3:6]
        p = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        assert v == -math.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2]) * p[0] / (p[0] * p[0] + p[1] * p[1] + p[2] * p[2])


FOUR = "kx ky kz ix iy iz jx jy jz lx ly lz"


def places():
    return [g.cols(f"{c}x {c}y {c}z") for c in "kijl"]



def test_dihedral_signs(spark):
    rows = [(1, 0, 0, 0, 0, 0, 0, 0, 1, math.cos(math.radians(t)), math.sin(math.radians(t)), 1) for t in (60, -60, 120, 0)]
    got = [r["p"] for r in values(spark, [tuple(map(float, r)) for r in rows], FOUR, p=g.dihedral(*places()))]
    assert abs(got[0]) == pytest.approx(60) and got[0] == pytest.approx(-got[1]) and abs(got[2]) == pytest.approx(120) and got[3] == pytest.approx(0, abs=0.1)


def test_derivatives_by_finite_differences(spark):
    rng = np.random.default_rng(4)
    x, h = rng.normal(size=12), 1e-6
    rows = [tuple(x)] + [tuple(x + s * h * np.eye(12)[i]) for i in range(12) for s in (1, -1)]
    leg = lambda a, b: tuple(q - p for p, q in zip(a, b, strict=True))
    at_k, at_l, at_i = g.dihedral_derivatives(*places())
    u, v = leg(places()[1], places()[0]), leg(places()[1], places()[2])
    at_u, at_v = g.angle_derivatives(u, v)
    exprs = {f"d{n}": e for n, e in enumerate([*at_k, *at_i, *at_l, *at_u, *at_v])}
    got = values(spark, [tuple(map(float, r)) for r in rows], FOUR, p=g.dihedral(*places()), a=g.angle(u, v), **exprs)
    slope = lambda name, i: (got[1 + 2 * i][name] - got[2 + 2 * i][name]) / (2 * h)
    want = [slope("p", i) for i in (0, 1, 2, 3, 4, 5, 9, 10, 11)] + [slope("a", i) for i in (0, 1, 2, 6, 7, 8)]
    assert [got[0][f"d{n}"] for n in range(15)] == pytest.approx(want, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("kind", kernels.KINDS)
def test_kernel_slopes(spark, kind):
    r = F.col("r")
    rs = [(x,) for x in np.linspace(0.3, 0.95, 14)]
    got = values(spark, rs, "r", s=kernels.kernel_slope(kind, r, 1.0, 0.25, 0.4, consistent=True), up=kernels.kernel(kind, r + 1e-6, 1.0, 0.25, 0.4), down=kernels.kernel(kind, r - 1e-6, 1.0, 0.25, 0.4))
    assert [x["s"] for x in got] == pytest.approx([(x["up"] - x["down"]) / 2e-6 for x in got], rel=1e-4, abs=1e-6)
    assert values(spark, [(1.0,), (2.0,)], "r", w=kernels.kernel(kind, r, 1.0, 0.25, 0.4)) == [(0.0,), (0.0,)]


def test_keys(spark):
    df = spark.range(1).select(F.posexplode(F.expr("flatten(transform(sequence(1, 4), a -> transform(sequence(a, 4), b -> struct(a, b))))")).alias("n", "t"))
    assert all(r["n"] == r["k"] for r in df.select("n", keys.pair_number(F.col("t.a"), F.col("t.b"), 4).alias("k")).collect())
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(keys.quadruple_key(F.lit(3), F.lit(1), F.lit(7), F.lit(8)))]).first()
    assert tuple(row) == (1, 3, 8, 7)
    types = spark.createDataFrame([(1, "A"), (2, "B")], "type_id int, name string")
    got = keys.resolve(spark.createDataFrame([("A",), ("2",), ("C",)], "name string"), types).collect()
    assert {r["name"]: r["type_id"] for r in got} == {"A": 1, "2": 2, "C": None}


def test_hat_basis(spark):
    got = values(spark, [(0.0,), (0.25,), (0.5,), (1.0,), (2.0,), (-1.0,)], "p", b=basis.hat(F.col("p"), 0.0, 1.0, 0.5))
    sums = [(b[0]["idx"], round(b[0]["val"], 6), round(b[1]["val"], 6)) for (b,) in got]
    assert sums == [(0, 1, 0), (0, 0.5, 0.5), (1, 1, 0), (1, 0, 1), (1, 0, 1), (0, 1, 0)]


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 7), st.integers(1, 9), st.floats(0, 1))
def test_bspline_partition_of_unity(order, bins, at):
    t = basis.knots(2.0, 5.0, bins + order - 1, order)
    p = np.array([2.0 + 3.0 * at])
    first, vals = basis.bspline_values(p, t, order)
    assert vals.sum() == pytest.approx(1) and (vals > -1e-12).all() and 0 <= first[0] <= bins - 1
    _, slopes = basis.bspline_slopes(p, t, order)
    assert slopes.sum() == pytest.approx(0, abs=1e-7)


def test_bspline_slopes_and_known_values(spark):
    t, h = basis.knots(0.0, 1.0, 8, 4), 1e-6
    p = np.linspace(0.05, 0.95, 9) + 0.003
    first, slopes = basis.bspline_slopes(p, t, 4)
    up, down = basis.bspline_values(p + h, t, 4)[1], basis.bspline_values(p - h, t, 4)[1]
    assert slopes == pytest.approx((up - down) / (2 * h), abs=1e-4)
    line = basis.evaluate(p, np.linspace(0, 1, 8), 0, 1, "bspline", 2)
    assert line == pytest.approx(p, abs=1e-5)
    got = spark.createDataFrame([(0.3,)], "p double").select(basis.bspline(0.0, 1.0, 8, 4)(F.col("p")).alias("b")).first()["b"]
    want = basis.bspline_values(np.array([0.3]), t, 4)
    assert [x["idx"] for x in got] == list(range(want[0][0], want[0][0] + 4)) and [x["val"] for x in got] == pytest.approx(want[1][0])


@pytest.mark.parametrize("order", [2, 4, 6])
def test_bspline_columns(spark, order):
    """The span polynomials as Columns give the recursion's values and slopes, out to and past the ends."""
    p = [1.5, 2.0, 2.2, 2.7499, 3.1, 4.4, 4.999, 5.0, 6.0]
    t = basis.knots(2.0, 5.0, 5 + order, order)
    got = spark.createDataFrame([(k, x) for k, x in enumerate([*p, None])], "k int, p double")
    got = got.select("k", basis.bspline(2.0, 5.0, 5 + order, order)(F.col("p")).alias("b"), basis.bspline(2.0, 5.0, 5 + order, order, slope=True)(F.col("p")).alias("s")).orderBy("k").collect()
    assert got[-1]["b"] is None and got[-1]["s"] is None
    for name, made in (("b", basis.bspline_values), ("s", basis.bspline_slopes)):
        first, vals = made(np.clip(p, t[0], t[-1]), t, order)
        assert [[x["idx"] for x in row[name]] for row in got[:-1]] == (first[:, None] + np.arange(order)).tolist()
        assert np.array([[x["val"] for x in row[name]] for row in got[:-1]]) == pytest.approx(vals, abs=1e-9)


def test_column_counts():
    assert basis.n_basis(0, 1, 0.1, "linear") == 11 and basis.n_basis(0, 1, 0.1, "bspline", 6) == 15 and basis.n_basis(-180, 180, 10, "bspline", 4, periodic=True) == 35


def test_control():
    c = parse_control("n_frames 20 comment\nblock_size 5\nbasis_type 1\npair_nonbonded_basis_set_resolution 0.01\nTemperature 310\n\n# nothing\n")
    assert (c.n_frames, c.block_size, c.basis_type, c.nonbonded_bin_width, c.temperature) == (20, 5, "linear", 0.01, 310.0) and c.check() is c
    with pytest.raises(ValueError, match="no_such_key"):
        parse_control("no_such_key 1")
    with pytest.warns(UserWarning):
        assert parse_control("no_such_key 1", strict=False) == Control()
    for bad in (Control(n_frames=7, block_size=2), Control(basis_type="x"), Control(exclusion_style=1), Control(angle_order=0)):
        with pytest.raises(ValueError):
            bad.check()
    assert {f.name for f in dataclasses.fields(Control)} == set(KEYS) and len(set(KEYS.values())) == len(KEYS)


#: Three control files of usual runs: pairs by B-splines, bonded by lines, and densities with bootstrapping.
RUNS = {
    "block_size 10\nstart_frame 1\nn_frames 200\nnonbonded_cutoff 2.0\nbasis_type 0\npair_nonbonded_bspline_basis_order 6\npair_nonbonded_basis_set_resolution 0.01\nmatrix_type 0\npair_nonbonded_output_binwidth 0.01\nprimary_output_style 2\noutput_solution_flag 1\noutput_spline_coeffs_flag 1\n": {"nonbonded_order": 6, "nonbonded_bin_width": 0.01, "output_style": 2},
    "basis_type 1\nangle_type 1\ndihedral_type 1\nexcluded_style 4\nangle_basis_set_resolution 2.5\nmax_angles_per_site 20\n": {"basis_type": "linear", "angle_bin_width": 2.5, "exclusion_style": 4, "most_angles": 20},
    "density_interactions_flag 3\ndensity_cutoff_distance 7.5\nbootstrapping_flag 1\nbootstrapping_num_estimates 9\nregularization_scalar 0.5\n": {"density_style": 3, "density_cutoff": 7.5, "bootstrap_replicas": 9, "tikhonov_parameter": 0.5},
}


def test_control_files_of_runs():
    for text, want in RUNS.items():
        made = parse_control(text).check()
        assert {k: getattr(made, k) for k in want} == want
