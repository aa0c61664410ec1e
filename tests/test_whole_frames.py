"""Queries whose frames hold all embedding sites between them: frames are vec_id % 5, whatever the size of the table."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from tessera.sources import views

WHOLE = [
    "p05_distance_derivative",
    "p09_stillinger_weber",
    "p13_density_kernels",
    "p14_kernel_slopes",
    "p16_hat_basis",
    "p17_bspline_basis",
    "p18_bspline_slope",
    "p19_spline_value",
    "p21_clamp",
    "p22_periodic_columns",
    "p20_table_lookup",
    "f01_range_filter",
    "a05_force_matrix",
    "a06_tabulated_target",
    "a08_virial_rows",
    "a12_normal_equations",
    "a12_normal_equations_joined",
    "a12_right_side",
    "a13_bootstrap_equations",
    "a19_merge_runs",
    "l01_preconditioner",
    "l04_least_squares",
    "l11_residual",
    "a11_threebody_fixed",
    "s06_frame_window",
    "j03_pair_neighbors",
    "j03_box_by_frame",
    "j04_triples",
    "j05_density_neighbors",
    "a04_local_density",
    "j09_exclusion_antijoin",
    "j12_interaction_lookup",
    "a01_range_minmax",
    "a02_range_rule",
    "a03_histogram",
    "l14_rdf",
    "l14_boltzmann",
    "l15_bonded_distribution",
    "a22_site_counts",
    "w01_reverse_trapezoid",
    "w02_pad",
    "w03_pad_linear",
    "w04_trim",
    "w05_wrap_axis",
    "w06_periodic_shift",
    "w07_flip",
]


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """1,200 ids, so that frames of 100 ids, or of 400, would be more than five."""
    folder = str(tmp_path_factory.mktemp("grown"))
    duckdb.execute(f"COPY (SELECT vec_id + 500 * k AS vec_id, label, embedding FROM '/root/testdata/sf0.01/embeddings.parquet', range(0, 3) r(k) WHERE vec_id < 400 ORDER BY 1) TO '{folder}/embeddings.parquet'")
    return folder


def test_whole_frames(spark, grown):
    got = views.sites(spark, grown, whole=True).select("frame_id", "site_id").toPandas()
    assert len(got) == 1200 and (got["frame_id"] == got["site_id"] % 5).all()


@pytest.mark.parametrize("name", WHOLE)
def test_no_pair_of_a_frame_is_left_out(name):
    """The SQL that the query is held against joins sites of whole frames."""
    sql = entry_point.oracle_sql()[name]
    assert "(vec_id % 5)::INT AS frame_id" in sql and "vec_id // 100" not in sql


@pytest.mark.parametrize("name", [n for n in WHOLE if n in ("j03_pair_neighbors", "j03_box_by_frame", "w03_pad_linear", "a05_force_matrix")])
def test_whole_frames_on_a_grown_table(spark, grown, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{grown}/embeddings.parquet'")
    want = duck.execute(entry_point.oracle_sql()[name]).df()
    got = entry_point.queries()[name](spark, grown).select(*want.columns).toPandas()
    key = list(want.columns)
    a, b = (df.astype(float).sort_values(key).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b) and (a == b).all().all()
    assert "frame_id" not in a or set(a["frame_id"] % 1000) <= set(range(5))
