"""Readers and run files."""

import numpy as np
import pytest

from tessera.sources import files, model, trr

DUMP = """ITEM: TIMESTEP
100
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp pp
-1 9
0 10
0 10
ITEM: ATOMS id type x y z fx fy fz
1 1 -2.0 1 2 0.5 0 0
2 2 3 4 11.0 0 -0.5 1e-3
ITEM: TIMESTEP
200
ITEM: NUMBER OF ATOMS
3
ITEM: BOX BOUNDS pp pp pp
0 10
0 10
0 10
ITEM: ATOMS id type x y z fx fy fz
1 1 0 1 2 0.5 0 0
2 2 3 4
"""


def test_dump(spark, tmp_path):
    (tmp_path / "a.dump").write_text(DUMP)
    rows = files.read_dump(spark, str(tmp_path)).orderBy("frame_id", "site_id").collect()
    assert [(r["frame_id"], r["timestep"], r["site_id"], r["type_id"]) for r in rows] == [(1, 100, 0, 1), (1, 100, 1, 2), (2, 200, 0, 1), (2, 200, 1, 2)]
    assert (rows[0]["x"], rows[1]["x"], rows[1]["z"], rows[1]["fz"], rows[0]["lx"]) == (9.0, 4.0, 1.0, 0.001, 10.0)
    assert [r["problem"] for r in rows] == [None, None, "wrong number of atoms", "too few fields"]
    assert files.check_sites(files.read_dump(spark, str(tmp_path))).count() == 0
    assert files.frame_window(files.read_dump(spark, str(tmp_path)), 2, 5).count() == 2


def test_frame_values(spark, tmp_path):
    (tmp_path / "w").write_text("1.0\n0.5\n2.5\n")
    assert [tuple(r) for r in files.read_frame_values(spark, str(tmp_path / "w"), "weight", 2).orderBy("frame_id").collect()] == [(2, 0.5), (3, 2.5)]


def test_frame_values_over_splits(spark, tmp_path):
    (tmp_path / "many").write_text("".join(f"{k}.5\n" + "\n" * (k % 3 == 0) for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        got = files.read_frame_values(spark, str(tmp_path / "many"), "weight", 11)
        assert got.rdd.getNumPartitions() > 4
        assert sorted(tuple(r) for r in got.collect()) == [(k, k - 0.5) for k in range(11, 3001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


TOP = """cgsites 7
cgtypes 2
A
B
density_nonbonded 2
G 2 A B
H 1 B
moltypes 2
mol 3 3
sitetypes
A
B
A
bonds 2
1 2
2 3
mol 1 1
sitetypes
B
bonds 0
system 2
1 2
2 1
"""


def test_topology(spark):
    top = model.parse_topology(TOP)
    assert top.types == ["A", "B"] and top.groups == {"G": ["A", "B"], "H": ["B"]} and top.system == [(1, 2), (2, 1)]
    made = model.topology_frames(spark, top)
    assert sorted(map(tuple, made["bonds"].collect())) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert [tuple(r) for r in made["sites"].orderBy("site_id").collect()] == [(0, 1, 0), (1, 2, 0), (2, 1, 0), (3, 1, 1), (4, 2, 1), (5, 1, 1), (6, 2, 2)]
    with pytest.raises(ValueError):
        model.parse_topology(TOP.replace("cgsites 7", "cgsites 8"))
    explicit = "cgsites 4\ncgtypes 1\nA\nmoltypes 1\nmol 4 -1\nsitetypes\nA\nA\nA\nA\nbonds 3\n1 2\n2 3\n3 4\nangles 2 1\n1 2 3\n2 3 4\ndihedrals 1 1\n1 2 3 4\nsystem 1\n1 1\n"
    mol = model.parse_topology(explicit).molecules[0]
    assert mol.angles == [(1, 2, 3), (2, 3, 4)] and mol.dihedrals == [(1, 2, 3, 4)]
    centre_first = model.parse_topology(explicit.replace("angles 2 1\n1 2 3\n2 3 4", "angles 2\n2 1 3\n3 2 4").replace("dihedrals 1 1\n1 2 3 4", "dihedrals 1\n2 3 1 4")).molecules[0]
    assert centre_first.angles == mol.angles and centre_first.dihedrals == mol.dihedrals


def test_ranges_tables_and_parameters(spark):
    got = model.parse_ranges("A B 0.2 1.5 fm\n2 2 -1 -1 none\n", ["A", "B"], 2)
    assert [g["types"] for g in got] == [[1, 2], [2, 2]] and got[0]["mode"] == "fm"
    for bad in ("A B 0.2 1.5 what", "A B 2 1 fm", "A B 0.2"):
        with pytest.raises(ValueError):
            model.parse_ranges(bad, ["A", "B"], 2)
    tabs = model.parse_tables("bond 1 0.5\n1 2\n1.0 2.0\n3\n2\n1\nangle 2 90\nA B A\nB A B\n0 180\n1\n2\n3\n", ["A", "B"])
    assert [(t["class"], t["types"], t["values"]) for t in tabs] == [("bond", [1, 2], [3, 2, 1]), ("angle", [1, 2, 1], [1, 2, 3]), ("angle", [2, 1, 2], [1, 2, 3])]
    assert model.table_rows(spark, tabs).count() == 9
    assert len(model.parse_density_parameters("G G 0.1\nG H 0.2\nH G 0.3\nH H 0.4\n", ["G", "H"], 1)) == 4
    with pytest.raises(ValueError):
        model.parse_density_parameters("G G 0.1\n", ["G", "H"], 1)
    assert model.parse_lambda("2 0\n0.1\n0.2\n") == [0.1, 0.2] and model.parse_lambda("0.3\n0.4\n") == [0.3, 0.4]
    lines = model.range_lines(spark.createDataFrame([("A", "B", 0.5, 1.0, "fm")], "t1 string, t2 string, lo double, hi double, mode string"), ["t1", "t2"])
    assert lines.first()["line"] == "A B 0.500000 1.000000 fm"


def test_dump_frames_count_over_files_and_splits(spark, tmp_path):
    frame = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS id type x y z\n1 1 0 1 2\n2 2 3 4 5\n"
    (tmp_path / "a.dump").write_text("".join(frame.format(t=t) for t in range(300)))
    (tmp_path / "b.dump").write_text("".join(frame.format(t=t).replace("\n", "\r\n") for t in range(300, 420)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        dump = files.read_dump(spark, str(tmp_path))
        assert dump.rdd.getNumPartitions() > 8
        got = sorted((r["frame_id"], r["timestep"], r["site_id"]) for r in dump.where("problem is null").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(t + 1, t, k) for t in range(420) for k in (0, 1)]


@pytest.mark.parametrize("double", [False, True])
def test_binary_frames_come_back(spark, tmp_path, double):
    rng = np.random.default_rng(2)
    made = [(10 * k, 0.5 * k, np.diag([3.0 + k, 4.0, 5.0]), rng.uniform(-1, 6, (7, 3)), rng.normal(size=(7, 3))) for k in range(9)]
    (tmp_path / "a.trr").write_bytes(b"".join(trr.encode(*frame, double=double) for frame in made))
    rows = trr.read_trr(spark, str(tmp_path / "a.trr")).orderBy("frame_id", "site_id").collect()
    assert [(r["frame_id"], r["timestep"], r["site_id"]) for r in rows] == [(k + 1, 10 * k, s) for k in range(9) for s in range(7)]
    for r in rows:
        step, time, box, x, f = made[r["frame_id"] - 1]
        side = np.diag(box)
        want = x[r["site_id"]] - side * np.floor(x[r["site_id"]] / side)
        assert np.allclose([r["x"], r["y"], r["z"]], want, atol=1e-5) and np.allclose([r["fx"], r["fy"], r["fz"]], f[r["site_id"]], atol=1e-6)
        assert (r["lx"], r["ly"], r["lz"], r["time"]) == pytest.approx((*side, time))


def test_binary_frames_that_cannot_be_read(spark, tmp_path):
    frame = lambda n, f=None: trr.encode(0, 0.0, np.eye(3), np.zeros((n, 3)), f)
    (tmp_path / "plain.trr").write_bytes(frame(2) * 3)
    assert trr.read_trr(spark, str(tmp_path / "plain.trr")).where("fx is null").count() == 6
    (tmp_path / "mixed.trr").write_bytes(frame(4) + frame(5) + frame(4))
    with pytest.raises(Exception, match="TRR frame|differ in size|record"):
        trr.read_trr(spark, str(tmp_path / "mixed.trr")).count()
    (tmp_path / "other").write_bytes(b"x" * 4000)
    with pytest.raises(ValueError, match="no TRR frame"):
        trr.read_trr(spark, str(tmp_path / "other"))
    skew = trr.encode(0, 0.0, np.array([[1.0, 0, 0], [0.5, 1, 0], [0, 0, 1]]), np.zeros((2, 3)))
    (tmp_path / "skew.trr").write_bytes(skew)
    with pytest.raises(Exception, match="rectangular"):
        trr.read_trr(spark, str(tmp_path / "skew.trr")).count()
