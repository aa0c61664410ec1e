"""Queries of sources, joins and aggregates (S*, J*, A1-A4, A20-A23, L14-L18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import blocks, neighbors, parameters, ranges, solve, topology
from ..sources import views as v
from .geometry import ANG, ANGLE_LEGS, ANGLES, BOTH, CUT, DIHEDRAL_LEGS, DIHEDRALS, MOLS, S, W, angle_rows, box, dihedral_rows, molecules, pairs_sql
from .registry import q6, query, r6

CHAIN = "chain AS (SELECT a.site_id AS i, b.site_id AS j FROM sites a JOIN sites b ON b.site_id = a.site_id + 5 WHERE (a.site_id // 5) % 4 <> 3)"
RANGES = "ranges AS (SELECT least(ti, tj) AS t1, greatest(ti, tj) AS t2, min(sqrt(r2)) AS lo, max(sqrt(r2)) AS hi, count(*) AS n FROM pairs GROUP BY 1, 2)"
BIN = 0.02
HIST = f"""{RANGES}, sized AS (SELECT t1, t2, lo, CAST(2 * floor((hi - lo) / {BIN}::DOUBLE + 0.5) AS INT) AS bins FROM ranges),
counted AS (SELECT p.t1, p.t2, bin, count(*) AS n FROM (SELECT least(ti, tj) AS t1, greatest(ti, tj) AS t2, s.bins, CAST(floor((sqrt(r2) - s.lo + 1e-6) / {BIN / 2}::DOUBLE) AS INT) AS bin FROM pairs q JOIN sized s ON s.t1 = least(q.ti, q.tj) AND s.t2 = greatest(q.ti, q.tj)) p WHERE bin < bins GROUP BY ALL),
hist AS (SELECT s.t1, s.t2, b.bin::INT AS bin, s.lo + (b.bin + 0.5::DOUBLE) * {BIN / 2}::DOUBLE AS centre, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT *, unnest(range(0, bins)) AS bin FROM sized) s JOIN LATERAL (SELECT s.bin AS bin) b ON true LEFT JOIN counted c ON c.t1 = s.t1 AND c.t2 = s.t2 AND c.bin = s.bin)"""
NUMBERS = "kinds AS (SELECT type_id, count(*)::DOUBLE AS n FROM sites WHERE frame_id = (SELECT min(frame_id) FROM sites) GROUP BY 1), numbers AS (SELECT a.type_id AS t1, b.type_id AS t2, CASE WHEN a.type_id = b.type_id THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END AS pairs FROM kinds a JOIN kinds b ON a.type_id <= b.type_id)"
SHELL = f"(4.0 * 3.1415926::DOUBLE * (pow(centre, 3) - pow(centre - {BIN / 2}::DOUBLE, 3)))"
FRAMES_SHARE = "(SELECT 1.0::DOUBLE / count(DISTINCT frame_id) FROM sites)"
RDF = f"{NUMBERS}, rdf AS (SELECT h.*, CASE WHEN n > 0 THEN n * 3.0::DOUBLE / {SHELL} * {FRAMES_SHARE} * 1.0::DOUBLE / nullif(m.pairs, 0) ELSE 0 END AS g FROM hist h JOIN numbers m ON m.t1 = h.t1 AND m.t2 = h.t2)"
KT = 300.0 * 0.0019872041


def near(spark, sf_dir, types: int = 10, cutoff: float = CUT, whole: bool = False):
    return neighbors.pairs(v.sites(spark, sf_dir, types, whole), cutoff, box())


def typed(pairs):
    return pairs.select("*", F.least("type_id_i", "type_id_j").alias("t1"), F.greatest("type_id_i", "type_id_j").alias("t2"), F.sqrt("r2").alias("p"))


def found_ranges(spark, sf_dir, whole: bool = False):
    return ranges.min_max(typed(near(spark, sf_dir, whole=whole)), ["t1", "t2"])


def hist(spark, sf_dir, whole: bool = False):
    p = typed(near(spark, sf_dir, whole=whole))
    return ranges.histogram(p, ranges.min_max(p, ["t1", "t2"]), ["t1", "t2"], BIN)


def chain(spark, sf_dir):
    sites = v.sites(spark, sf_dir).select("site_id")
    nxt = sites.select(F.col("site_id").alias("j"))
    return sites.where(F.floor(F.col("site_id") / 5) % 4 != 3).withColumn("j", F.col("site_id") + 5).join(nxt, "j").select(F.col("site_id").alias("i"), "j")


@query("s06_frame_window", f"WITH {W} SELECT frame_id, site_id, type_id FROM sites WHERE frame_id BETWEEN 1 AND 3")
def s06(spark, sf_dir):
    from ..sources.files import frame_window

    return frame_window(v.sites(spark, sf_dir, whole=True), 1, 3).select("frame_id", "site_id", "type_id")


@query("s07_frame_weights", f"WITH {S}, {v.WEIGHTS_SQL} SELECT frame_id, site_id, weight FROM sites JOIN weights USING (frame_id) WHERE weight <> 0")
def s07(spark, sf_dir):
    sites = v.sites(spark, sf_dir)
    return sites.join(v.frame_weights(sites).where("weight <> 0"), "frame_id").select("frame_id", "site_id", "weight")


@query("j01_cells", f"WITH {S} SELECT site_id, (least(floor(x / 0.2::DOUBLE), 4) * 25 + least(floor(y / 0.2::DOUBLE), 4) * 5 + least(floor(z / 0.2::DOUBLE), 4))::INT AS cell FROM sites")
def j01(spark, sf_dir):
    counts = neighbors.cell_counts(box(), CUT)
    return neighbors.with_cells(v.sites(spark, sf_dir), box(), counts).select("site_id", F.col("cell").cast("int").alias("cell"))


@query("j03_pair_neighbors", f"WITH {W}, {pairs_sql()} SELECT frame_id, i, j, {q6('sqrt(r2)')} AS r FROM pairs")
def j03(spark, sf_dir):
    return near(spark, sf_dir, whole=True).select("frame_id", "i", "j", r6(F.sqrt("r2")).alias("r"))


_TWO = "two AS (SELECT frame_id, site_id, type_id, x, y, z, 1.0::DOUBLE AS lx, 1.0::DOUBLE AS ly, 1.0::DOUBLE AS lz FROM sites UNION ALL SELECT frame_id + 1000, site_id, type_id, x * 1.25::DOUBLE, y * 0.5::DOUBLE, z, 1.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE FROM sites)"
_FAR = [f"least(abs(a.{c} - b.{c}), a.l{c} - abs(a.{c} - b.{c}))" for c in "xyz"]


@query("j03_box_by_frame", f"WITH {W}, {_TWO}, near AS (SELECT a.frame_id, least(a.type_id, b.type_id) AS t1, greatest(a.type_id, b.type_id) AS t2, {' + '.join(f'pow({d}, 2)' for d in _FAR)} AS r2 FROM two a JOIN two b ON a.frame_id = b.frame_id AND a.site_id < b.site_id WHERE {' + '.join(f'pow({d}, 2)' for d in _FAR)} <= 0.2::DOUBLE * 0.2::DOUBLE) SELECT frame_id, t1, t2, count(*) AS n, {q6('min(sqrt(r2))')} AS lo, {q6('max(sqrt(r2))')} AS hi FROM near GROUP BY ALL")
def j03_box(spark, sf_dir):
    """Two frames with boxes of their own, as in runs at constant pressure."""
    one = v.sites(spark, sf_dir, whole=True).select("frame_id", "site_id", "type_id", "x", "y", "z", *[F.lit(1.0).alias(f"l{a}") for a in "xyz"])
    other = one.select((F.col("frame_id") + 1000).alias("frame_id"), "site_id", "type_id", F.col("x") * 1.25, F.col("y") * 0.5, "z", F.lit(1.25), F.lit(0.5), F.lit(1.0))
    near = typed(neighbors.pairs(one.union(other), CUT, ("lx", "ly", "lz")))
    return near.groupBy("frame_id", "t1", "t2").agg(F.count("*").alias("n"), r6(F.min("p")).alias("lo"), r6(F.max("p")).alias("hi"))


_LINE = "least(abs(a.x - b.x), 500.0::DOUBLE - abs(a.x - b.x))"


@query("j03_line_neighbors", f"WITH {v.LINE_SITES_SQL} SELECT a.frame_id, least(a.type_id, b.type_id) AS t1, greatest(a.type_id, b.type_id) AS t2, count(*) AS n, {q6(f'min({_LINE})')} AS lo FROM line_sites a JOIN line_sites b ON a.frame_id = b.frame_id AND a.site_id < b.site_id AND pow({_LINE}, 2) <= 4.0 GROUP BY ALL")
def j03_line(spark, sf_dir):
    """The one-dimensional case, over all events."""
    p = typed(neighbors.pairs(v.line_sites(spark, sf_dir), 2.0, (v.LINE_BOX,)))
    return p.groupBy("frame_id", "t1", "t2").agg(F.count("*").alias("n"), r6(F.min("p")).alias("lo"))


_TRI = f"""{pairs_sql(0.12)}, near AS (SELECT frame_id, i AS c, j AS o, dx, dy, dz FROM pairs UNION ALL SELECT frame_id, j, i, -dx, -dy, -dz FROM pairs),
tri AS (SELECT a.frame_id, a.c AS centre, a.o AS k, b.o AS l, a.dx * b.dx + a.dy * b.dy + a.dz * b.dz AS uv FROM near a JOIN near b ON a.frame_id = b.frame_id AND a.c = b.c AND a.o < b.o)"""


@query("j04_triples", f"WITH {W}, {_TRI} SELECT frame_id, centre, k, l, {q6('uv')} AS uv FROM tri")
def j04(spark, sf_dir):
    t = blocks.triples(v.sites(spark, sf_dir, whole=True), 0.12, box())
    return t.select("frame_id", "centre", "k", "l", r6(F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy") + F.col("uz") * F.col("vz")).alias("uv"))


GROUPS = "groups AS (SELECT DISTINCT type_id, g.group_id, g.weight FROM sites JOIN (VALUES ('low', 1.0::DOUBLE), ('even', 0.5::DOUBLE)) g(group_id, weight) ON CASE WHEN g.group_id = 'low' THEN type_id <= 5 ELSE type_id % 2 = 0 END)"
NEAR = "near AS (SELECT frame_id, i, j, ti, tj, r2 FROM pairs UNION ALL SELECT frame_id, j, i, tj, ti, r2 FROM pairs)"


def groups(sites):
    """Two overlapping groups of types: low (1-5) and even."""
    member = F.array(F.when(F.col("type_id") <= 5, F.struct(F.lit("low").alias("group_id"), F.lit(1.0).alias("weight"))), F.when(F.col("type_id") % 2 == 0, F.struct(F.lit("even").alias("group_id"), F.lit(0.5).alias("weight"))))
    kinds = sites.select("type_id").distinct().withColumn("m", F.explode(member)).where("m is not null")
    return kinds.select("type_id", "m.group_id", "m.weight")


@query("j05_density_neighbors", f"WITH {W}, {pairs_sql()}, {GROUPS}, {NEAR} SELECT h.group_id AS home, o.group_id AS other, count(*) AS n, {q6('sum(o.weight)')} AS w FROM near JOIN groups h ON h.type_id = ti JOIN groups o ON o.type_id = tj WHERE r2 < {CUT * CUT!r}::DOUBLE GROUP BY ALL")
def j05(spark, sf_dir):
    sites = v.sites(spark, sf_dir, whole=True)
    return neighbors.density_pairs(sites, groups(sites), CUT, box()).groupBy("home", "other").agg(F.count("*").alias("n"), r6(F.sum("weight")).alias("w"))


@query("a04_local_density", f"WITH {W}, {pairs_sql()}, {GROUPS}, {NEAR} SELECT frame_id, i AS site_id, h.group_id AS home, o.group_id AS other, {q6('sum(o.weight * pow(0.2::DOUBLE - sqrt(r2), 3) * (0.2::DOUBLE + 3.0 * sqrt(r2)) / pow(0.2::DOUBLE, 4))')} AS density FROM near JOIN groups h ON h.type_id = ti JOIN groups o ON o.type_id = tj WHERE r2 < {CUT * CUT!r}::DOUBLE GROUP BY ALL")
def a04(spark, sf_dir):
    sites = v.sites(spark, sf_dir, whole=True)
    p = neighbors.density_pairs(sites, groups(sites), CUT, box())
    return p.groupBy("frame_id", F.col("i").alias("site_id"), "home", "other").agg(r6(F.sum(F.col("weight") * kernels.kernel("lucy", F.sqrt("r2"), CUT))).alias("density"))


@query("j06_angles", f"WITH {MOLS}, {BOTH}, {ANGLES} SELECT k, j, l FROM angles")
def j06(spark, sf_dir):
    return topology.angles(molecules(spark, sf_dir)[1]).select("k", "j", "l")


@query("j07_dihedrals", f"WITH {MOLS}, {BOTH}, {DIHEDRALS} SELECT k, i, j, l FROM dihedrals")
def j07(spark, sf_dir):
    return topology.dihedrals(molecules(spark, sf_dir)[1])


@query("j08_bonded_types", f"WITH {MOLS}, {BOTH}, {DIHEDRALS}, {DIHEDRAL_LEGS} SELECT least(type_i, type_j) AS t1, greatest(type_i, type_j) AS t2, CASE WHEN type_i > type_j OR (type_i = type_j AND type_k > type_l) THEN type_l ELSE type_k END AS t3, CASE WHEN type_i > type_j OR (type_i = type_j AND type_k > type_l) THEN type_k ELSE type_l END AS t4, count(*) AS n, {q6('min(p)')} AS lo, {q6('max(p)')} AS hi FROM dih GROUP BY 1, 2, 3, 4")
def j08(spark, sf_dir):
    key = parameters.key_columns("dihedral")
    return dihedral_rows(spark, sf_dir).groupBy(*[c.alias(f"t{i + 1}") for i, c in enumerate(key)]).agg(F.count("*").alias("n"), r6(F.min("p")).alias("lo"), r6(F.max("p")).alias("hi"))


_EX4 = f"{BOTH.replace('bonds', 'chain')}, {ANGLES}, {DIHEDRALS}, ex AS (SELECT least(i, j) AS i, greatest(i, j) AS j FROM chain UNION SELECT k, l FROM angles UNION SELECT least(k, l), greatest(k, l) FROM dihedrals)"


@query("j09_exclusion_antijoin", f"WITH {W}, {pairs_sql(0.4)}, {CHAIN}, {_EX4} SELECT p.i, p.j, {q6('r2')} AS r2 FROM pairs p ANTI JOIN ex ON ex.i = p.i AND ex.j = p.j")
def j09(spark, sf_dir):
    ex = topology.exclusions(chain(spark, sf_dir), 4)
    return neighbors.pairs_outside(v.sites(spark, sf_dir, whole=True), 0.4, box(), ex).select("i", "j", r6("r2").alias("r2"))


_STYLES = {2: "SELECT least(i, j) AS i, greatest(i, j) AS j FROM bonds", 3: "SELECT least(i, j) AS i, greatest(i, j) AS j FROM bonds UNION SELECT k, l FROM angles", 4: "SELECT least(i, j) AS i, greatest(i, j) AS j FROM bonds UNION SELECT k, l FROM angles UNION SELECT least(k, l), greatest(k, l) FROM dihedrals"}
for _style, _sql in _STYLES.items():

    @query(f"j10_exclusions_{_style}", f"WITH {MOLS}, {BOTH}, {ANGLES}, {DIHEDRALS} SELECT DISTINCT i, j FROM ({_sql})")
    def j10(spark, sf_dir, style=_style):
        return topology.exclusions(molecules(spark, sf_dir)[1], style)


_REACH = f"WITH {MOLS}, bonded AS (SELECT mol_id, i AS id FROM bonds UNION SELECT mol_id, j FROM bonds), lead AS (SELECT *, min(id) OVER (PARTITION BY mol_id) AS molecule FROM bonded)"


@query("j11_bond_closure", f"{_REACH} SELECT id, molecule FROM lead")
def j11(spark, sf_dir):
    return topology.reachable(molecules(spark, sf_dir)[1]).select("id", "molecule")


@query("j10_exclusions_5", f"{_REACH} SELECT a.id AS i, b.id AS j FROM lead a JOIN lead b ON a.molecule = b.molecule AND a.id < b.id")
def j10_5(spark, sf_dir):
    return topology.exclusions(molecules(spark, sf_dir)[1], 5)


@query("j12_interaction_lookup", f"WITH {W}, {pairs_sql()}, {v.WEIGHTS_SQL}, spec AS (SELECT a.type_id AS t1, b.type_id AS t2, (row_number() OVER (ORDER BY a.type_id, b.type_id) - 1)::BIGINT AS intrxn FROM (SELECT DISTINCT type_id FROM sites) a JOIN (SELECT DISTINCT type_id FROM sites) b ON a.type_id <= b.type_id WHERE (a.type_id + b.type_id) % 2 = 0) SELECT intrxn, count(*) AS n FROM pairs JOIN spec ON t1 = least(ti, tj) AND t2 = greatest(ti, tj) GROUP BY intrxn")
def j12(spark, sf_dir):
    from pyspark.sql import Window

    kinds = v.sites(spark, sf_dir, whole=True).agg(F.collect_set("type_id").alias("t")).select("t", F.explode("t").alias("t1")).select("t1", F.explode(F.filter("t", lambda b: b >= F.col("t1"))).alias("t2"))
    spec = kinds.where((F.col("t1") + F.col("t2")) % 2 == 0).withColumn("intrxn", (F.row_number().over(Window.orderBy("t1", "t2")) - 1).cast("long"))  # types squared at most
    return typed(near(spark, sf_dir, whole=True)).join(spec, ["t1", "t2"]).groupBy("intrxn").agg(F.count("*").alias("n"))


@query("j13_density_groups", f"WITH {S}, {GROUPS} SELECT group_id, type_id, {q6('weight')} AS weight FROM groups")
def j13(spark, sf_dir):
    return groups(v.sites(spark, sf_dir)).select("group_id", "type_id", r6("weight").alias("weight"))


@query("a01_range_minmax", f"WITH {W}, {pairs_sql()}, {RANGES} SELECT t1, t2, {q6('lo')} AS lo, {q6('hi')} AS hi, n FROM ranges")
def a01(spark, sf_dir):
    return found_ranges(spark, sf_dir, whole=True).select("t1", "t2", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query("a01_angle_ranges", f"WITH {MOLS}, {BOTH}, {ANGLES}, {ANGLE_LEGS}, {ANG} SELECT type_j AS t1, least(type_k, type_l) AS t2, greatest(type_k, type_l) AS t3, {q6('min(degrees(acos(c)))')} AS lo, {q6('max(degrees(acos(c)))')} AS hi, count(*) AS n FROM ang GROUP BY 1, 2, 3")
def a01_angle(spark, sf_dir):
    key = parameters.key_columns("angle")
    rows = angle_rows(spark, sf_dir).select(*[c.alias(f"t{i + 1}") for i, c in enumerate(key)], "p")
    return ranges.min_max(rows, ["t1", "t2", "t3"]).select("t1", "t2", "t3", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query("a02_range_rule", f"WITH {W}, {pairs_sql()}, {RANGES}, spec AS (SELECT a.type_id AS t1, b.type_id AS t2 FROM (SELECT DISTINCT type_id FROM sites) a JOIN (SELECT DISTINCT type_id FROM sites UNION SELECT 11) b ON a.type_id <= b.type_id) SELECT s.t1, s.t2, {q6('CASE WHEN n IS NULL THEN -1 ELSE lo END')} AS lo, {q6('CASE WHEN n IS NULL THEN -1 ELSE least(hi, 0.1::DOUBLE) END')} AS hi, CASE WHEN n IS NULL OR lo > 0.1::DOUBLE THEN 'none' ELSE 'fm' END AS mode FROM spec s LEFT JOIN ranges r ON r.t1 = s.t1 AND r.t2 = s.t2")
def a02(spark, sf_dir):
    kinds = v.sites(spark, sf_dir, whole=True).agg(F.collect_set("type_id").alias("t")).select("t", F.explode("t").alias("t1")).select("t1", F.explode(F.filter(F.array_union("t", F.array(F.lit(11))), lambda b: b >= F.col("t1"))).alias("t2"))
    return ranges.finish_ranges(found_ranges(spark, sf_dir, whole=True), kinds, ["t1", "t2"], 0.1).select("t1", "t2", r6("lo").alias("lo"), r6("hi").alias("hi"), "mode")


@query("a03_histogram", f"WITH {W}, {pairs_sql()}, {HIST} SELECT t1, t2, bin, {q6('centre')} AS centre, n FROM hist")
def a03(spark, sf_dir):
    return hist(spark, sf_dir, whole=True).select("t1", "t2", "bin", r6("centre").alias("centre"), "n")


def frames_share(spark, sf_dir, whole: bool = False) -> float:
    return 1.0 / max(1, v.sites(spark, sf_dir, whole=whole).select("frame_id").distinct().count())


def rdf(spark, sf_dir, whole: bool = False):
    return ranges.rdf(hist(spark, sf_dir, whole), ranges.pair_numbers(v.sites(spark, sf_dir, whole=whole)), ["t1", "t2"], BIN, v.BOX**3, frames_share(spark, sf_dir, whole))


@query("l14_rdf", f"WITH {W}, {pairs_sql()}, {HIST}, {RDF} SELECT t1, t2, bin, {q6('g')} AS g FROM rdf")
def l14(spark, sf_dir):
    return rdf(spark, sf_dir, whole=True).select("t1", "t2", "bin", r6("g").alias("g"))


@query("l14_boltzmann", f"WITH {W}, {pairs_sql()}, {HIST}, {RDF} SELECT t1, t2, bin, {q6(f'CASE WHEN g > 0 THEN -{KT!r}::DOUBLE * ln(g) ELSE 100 END')} AS u FROM rdf")
def l14_u(spark, sf_dir):
    return ranges.boltzmann(rdf(spark, sf_dir, whole=True), KT).select("t1", "t2", "bin", r6("u").alias("u"))


@query("l15_bonded_distribution", f"WITH {W}, {pairs_sql()}, {HIST} SELECT t1, t2, bin, {q6(f'n * 2.0::DOUBLE * {FRAMES_SHARE}')} AS g FROM hist")
def l15(spark, sf_dir):
    return ranges.distribution(hist(spark, sf_dir, whole=True), frames_share(spark, sf_dir, whole=True)).select("t1", "t2", "bin", r6("g").alias("g"))


@query("l17_reweighting", f"WITH {S}, {v.WEIGHTS_SQL} SELECT type_id, {q6('sum(weight * fx * fx) / (SELECT sum(weight) FROM weights)')} AS f2, {q6('sum(weight * 4.0::DOUBLE * fx * fx) / (SELECT sum(weight) FROM weights)')} AS f2_volume FROM sites JOIN weights USING (frame_id) GROUP BY type_id")
def l17(spark, sf_dir):
    sites = v.sites(spark, sf_dir)
    w = v.frame_weights(sites)
    total = w.agg(F.sum("weight").alias("w"))
    s = sites.join(w, "frame_id").groupBy("type_id").agg(F.sum(F.col("weight") * F.col("fx") * F.col("fx")).alias("s"), F.sum(F.col("weight") * 2.0**2 * F.col("fx") * F.col("fx")).alias("t"))
    return s.withColumn("w", total.scalar()).select("type_id", r6(F.col("s") / F.col("w")).alias("f2"), r6(F.col("t") / F.col("w")).alias("f2_volume"))


@query("l18_state_sampling", f"WITH {S}, many AS (SELECT *, unnest(range(1, 4)) AS sample FROM sites) SELECT frame_id, site_id, sample::INT AS sample, CASE WHEN ((site_id * 7919 + frame_id * 104729 + sample * 15485863) % 2147483647) / 2147483647.0::DOUBLE <= 0.3::DOUBLE + 0.4::DOUBLE * (type_id % 2) THEN 1 ELSE 2 END AS type_id FROM many")
def l18(spark, sf_dir):
    from ..sources.files import sample_states

    sites = v.sites(spark, sf_dir).withColumn("state_p", 0.3 + 0.4 * (F.col("type_id") % 2))
    u = (F.col("site_id") * 7919 + F.col("frame_id") * 104729 + F.col("sample") * 15485863) % 2147483647 / 2147483647.0
    return sample_states(sites, 3, u).select("frame_id", "site_id", "sample", "type_id")


@query("a20_standard_error", f"WITH {S}, vals AS (SELECT type_id, fx AS v FROM sites) SELECT type_id, {q6('sqrt(greatest(sum(v * v) - sum(v) * sum(v) / count(v), 0)) / count(v)')} AS se FROM vals GROUP BY type_id")
def a20(spark, sf_dir):
    return solve.standard_error(v.sites(spark, sf_dir).select("type_id", F.col("fx").alias("v")), ["type_id"]).select("type_id", r6("se").alias("se"))


@query("a22_site_counts", f"WITH {W}, {NUMBERS} SELECT t1, t2, {q6('pairs')} AS pairs FROM numbers")
def a22(spark, sf_dir):
    return ranges.pair_numbers(v.sites(spark, sf_dir, whole=True)).select("t1", "t2", r6("pairs").alias("pairs"))


@query("a23_checks", f"WITH {S} SELECT frame_id, count(*) AS sites, count(DISTINCT type_id) AS types, count(*) FILTER (WHERE fx <> 0) AS nonzero FROM sites GROUP BY frame_id")
def a23(spark, sf_dir):
    return v.sites(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("sites"), F.count_distinct("type_id").alias("types"), F.count_if(F.col("fx") != 0).alias("nonzero"))
