"""Findings of round 4: each failed before its mending."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tessera.functions import basis
from tessera.functions import geometry as g
from tessera.operators import blocks, neighbors, normal, threebody


def same_as_sql(spark, folder, name, *tables):
    """Rows of a query that differ from its SQL, over the given tables of a folder."""
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = duck.execute(entry_point.oracle_sql()[name]).df()
    got = entry_point.queries()[name](spark, folder).select(*want.columns).toPandas()
    key = list(want.columns)
    a, b = (df.astype(float).sort_values(key).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b)
    return a[~((a == b) | (a.isna() & b.isna())).all(axis=1)]


def test_angles_of_sites_on_one_spot(spark, tmp_path):
    """ranks 1 and 5 lie on one spot, so a leg has no length; the gradients are null there, as in SQL, and not an error."""
    rows = [(1, 1, 10.0, 0.02, 0.05), (1, 5, 10.0, 0.02, 0.0), (1, 6, 11.0, 0.03, 0.01), (1, 7, 11.0, 0.05, 0.01), (2, 1, 12.0, 0.02, 0.03), (2, 2, 10.0, 0.02, 0.05), (2, 6, 10.0, 0.02, 0.0)]
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {', '.join(map(str, rows))}) t(l_orderkey, l_linenumber, l_quantity, l_discount, l_tax)) TO '{tmp_path}/lineitem.parquet'")
    assert same_as_sql(spark, str(tmp_path), "p07_angle_derivatives", "lineitem").empty
    got = entry_point.queries()["p07_angle_derivatives"](spark, str(tmp_path)).toPandas()
    assert len(got) == 3 and got["at_k_x"].isna().sum() == 2


@pytest.mark.parametrize("name", ["p17_bspline_basis", "p18_bspline_slope"])
def test_bspline_basis_writes_a_point_out_once(spark, sf_dir, name):
    """the array of four entries was exploded with the pair's distance written out at each coefficient (177 task seconds on check_s, 29 now)."""
    plan = entry_point.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at(") == 4 and plan.count("SQRT(") <= 2  # 16 and 53 before


def test_spline_values_do_not_shuffle_pairs(spark, sf_dir):
    """F8: each pair's two parts went through a shuffle by pair to be summed."""
    plan = entry_point.queries()["p19_spline_value"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    assert same_as_sql(spark, sf_dir, "p19_spline_value", "embeddings").empty


@pytest.mark.parametrize(("cutoff", "home_sites"), [(0.2, 2048), (0.2, 3), (0.45, 7)])
def test_entries_from_blocks(spark, monkeypatch, cutoff, home_sites):
    """Cells dealt in parts, one cell for an axis, sites on one spot and equal ids give the entries that rows of pairs give."""
    rng = np.random.default_rng(5)
    at = np.clip(rng.normal(0.5, 0.25, (240, 3)), 0, 0.999).round(3)
    at[7] = at[8]
    rows = [(int(k % 2), int(k if k != 30 else 32), int(rng.integers(1, 3)), *map(float, x)) for k, x in enumerate(at)]
    sites = spark.createDataFrame(rows, "frame_id int, site_id long, type_id int, x double, y double, z double")
    monkeypatch.setattr(blocks, "HOME_SITES", home_sites)
    box, hi = (1.0, 1.0, 1.0), 0.2
    near = neighbors.pairs(sites, cutoff, box).where("r2 > 0")
    first = 5 * (F.col("type_id_i") + F.col("type_id_j") - 2)
    want = normal.collected(normal.pair_entries(near, basis.hat(F.sqrt("r2"), 0.02, hi, 0.045), first)).toPandas()
    got = blocks.pair_entries(sites, cutoff, box, 2, 0.02, hi, 0.045).toPandas()
    key = ["frame_id", "site_id", "dim", "col"]
    a, b = (df.set_index(key)["v"].sort_index() for df in (got, want))
    assert a.index.equals(b.index) and a.to_numpy() == pytest.approx(b.to_numpy(), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("name", ["a05_force_matrix", "a12_normal_equations_joined", "l01_preconditioner", "a19_merge_runs", "a16_block_average", "a15_tsqr", "a13_bootstrap_equations"])
def test_pairs_of_force_matrices_are_not_rows(spark, sf_dir, monkeypatch, name):
    """F9, F11, F14 to F18: each pair became twelve rows, which were summed by site and column."""
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self: self)  # the plan before it is wanted
    plan = entry_point.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    if name in entry_point.oracle_sql():
        assert same_as_sql(spark, sf_dir, name, "embeddings").empty


@pytest.fixture(scope="module")
def crowded(spark):
    """Sites of two frames, some of them on a line, on one spot, or alone."""
    rng = np.random.default_rng(9)
    at = np.clip(rng.normal(0.5, 0.15, (60, 3)), 0, 0.999).round(3)
    at[10:16] = np.array([0.4, 0.4, 0.4]) + np.arange(6)[:, None] * np.array([0.01, 0.02, 0.0])
    at[20], at[21] = at[22], [0.01, 0.02, 0.99]
    rows = [(k % 2 if k > 21 else 0, k, 1, *map(float, x)) for k, x in enumerate(at)]
    sites = spark.createDataFrame(rows, "frame_id int, site_id long, type_id int, x double, y double, z double")
    legs = neighbors.triples(sites, 0.12, (1.0, 1.0, 1.0)).where("ux * ux + uy * uy + uz * uz > 0 and vx * vx + vy * vy + vz * vz > 0")
    return sites, legs.localCheckpoint()


def entries_equal(got, want):
    key = ["frame_id", "site_id", "dim", "col"]
    a, b = (df.toPandas().set_index(key)["v"].sort_index() for df in (got, want))
    assert len(a) > 100 and a.index.equals(b.index)
    assert np.abs(a.to_numpy() - b.to_numpy()).max() < 1e-10 * np.abs(b.to_numpy()).max()  # parallel legs leave a difference of some 1e-6, of which a double has ten digits


def test_fitted_threebody_forces_from_sites(spark, crowded, sf_dir):
    """a row was made of each triple and basis function (not ended in 165 s on check_s, 14.3 s now)."""
    sites, legs = crowded
    u, v = (tuple(F.col(f"{s}{a}") for a in "xyz") for s in "uv")
    theta = legs.select("*", g.angle(u, v).alias("theta")).localCheckpoint()
    want = threebody.fitted_entries(theta, basis.bspline(0.0, 180.0, 8, 4)(F.col("theta")), basis.bspline(0.0, 180.0, 8, 4, slope=True)(F.col("theta")), 0.12, 0.05)
    entries_equal(threebody.fitted_from_sites(sites, 0.12, (1.0, 1.0, 1.0), 0.05, 8), want)
    plan = entry_point.queries()["a11_threebody_fitted"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("order", [2, 3, 5])
def test_splines_in_powers(order):
    values, slopes, start, width = threebody._powers(order + 3, order, 0.0, 180.0)
    p = np.linspace(0.0, 180.0, 80)[1:-1]
    x = (p - start) / width
    up = [np.maximum(x - j, 0.0) for j in range(1, 4)]
    for (first, want), got in (
        (basis.bspline_values(p, basis.knots(0.0, 180.0, order + 3, order), order), np.stack([*[x**m for m in range(order)], *[y ** (order - 1) for y in up]], 1) @ values.T),
        (basis.bspline_slopes(p, basis.knots(0.0, 180.0, order + 3, order), order), np.stack([*[x**m for m in range(order - 1)], *[np.where(y > 0, y ** (order - 2), 0.0) for y in up]], 1) @ slopes.T),
    ):
        dense = np.zeros_like(got)
        np.put_along_axis(dense, first[:, None] + np.arange(order), want, 1)
        assert np.abs(got - dense).max() < 1e-11


def test_fixed_threebody_forces_from_sites(spark, crowded, sf_dir):
    """a row was made of each triple; the cosine's powers are summed over a centre's legs instead."""
    sites, legs = crowded
    entries_equal(threebody.fixed_from_sites(sites, 0.12, (1.0, 1.0, 1.0), 0.05, -0.1, column=3), threebody.fixed_entries(legs, 0.12, 0.05, -0.1, column=3))
    plan = entry_point.queries()["a11_threebody_fixed"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    assert same_as_sql(spark, sf_dir, "a11_threebody_fixed", "embeddings").empty


def test_exclusions_do_not_shuffle_pairs(spark, sf_dir):
    """pairs went through a shuffle to meet the exclusions; these go with the sites now."""
    df = entry_point.queries()["j09_exclusion_antijoin"](spark, sf_dir)
    assert "LeftAnti" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert same_as_sql(spark, sf_dir, "j09_exclusion_antijoin", "embeddings").empty


def test_pairs_outside_exclusions(spark):
    rng = np.random.default_rng(4)
    sites = spark.createDataFrame([(0, k, 1, *map(float, x)) for k, x in enumerate(rng.random((80, 3)))], "frame_id int, site_id long, type_id int, x double, y double, z double")
    ex = spark.createDataFrame([(i, j) for i in range(0, 60, 3) for j in range(i + 1, 80, 2)], "i long, j long")
    near = neighbors.pairs(sites, 0.3, (1.0, 1.0, 1.0))
    want, got = neighbors.without_excluded(near, ex), neighbors.pairs_outside(sites, 0.3, (1.0, 1.0, 1.0), ex)
    assert got.columns == near.columns and 0 < want.count() < near.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_triples_do_not_shuffle_pairs(spark, sf_dir, monkeypatch):
    """both legs' pairs went through a shuffle by their centre."""
    plan = entry_point.queries()["j04_triples"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in plan and "Join" not in above
    rng = np.random.default_rng(6)
    rows = [(k % 2, k, 1, *map(float, x)) for k, x in enumerate(np.clip(rng.normal(0.5, 0.15, (90, 3)), 0, 0.999).round(3))] + [(0, 200, 1, 0.5, 0.5, 0.5), (0, 201, 1, 0.5, 0.5, 0.5), (1, 202, 1, 0.01, 0.99, 0.5)]
    sites = spark.createDataFrame(rows, "frame_id int, site_id long, type_id int, x double, y double, z double")
    monkeypatch.setattr(blocks, "LISTED_SITES", 2)
    got = blocks.triples(sites, 0.15, (1.0, 1.0, 1.0))
    want = neighbors.triples(sites, 0.15, (1.0, 1.0, 1.0)).select(*got.columns)
    a, b = (df.toPandas().sort_values(["frame_id", "centre", "k", "l"]).reset_index(drop=True) for df in (got, want))
    assert len(a) > 100 and (a == b).all().all()


def test_parallel_legs_are_met_in_parts():
    """legs on one line, of which a centre may have any number, are held a bounded number at a time."""
    rng = np.random.default_rng(8)
    h = np.sort(rng.integers(0, 3, 90))
    u = rng.normal(size=(90, 3))
    u[::2] = u[0] * rng.choice([-1.0, 1.0], 45)[:, None]
    u /= np.sqrt((u * u).sum(1))[:, None]
    parts = list(threebody._all_but_parallel(h, list(u.T), held=50))
    got = {(min(k, m), max(k, m)) for part in parts for k, m in zip(*part[:2], strict=True)}
    c = u @ u.T
    assert len(parts) > 5 and max(len(p[0]) for p in parts) <= 50 + 90 and sum(len(p[0]) for p in parts) == len(got)
    assert got == {(k, m) for k in range(90) for m in range(k + 1, 90) if h[k] == h[m] and abs(c[k, m]) > 1 - 1e-6}
