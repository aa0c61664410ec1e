"""Force matching: sparse matrix entries, targets, and distributed weighted normal equations.

An entry is (frame_id, site_id, dim, col, v): the force of basis function `col` on one coordinate of a site. Entries stay
relational and sparse. Products A'A come from `gram`: rows are dealt by (frame, site), each partition multiplies its own
dense blocks and gives one upper triangle, and triangles are summed; or from `gram_joined`, a self-join on the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

ROW = ["frame_id", "site_id", "dim"]


def pair_entries(pairs: DataFrame, basis: Column, first_column: Column | int = 0, dims: str = "xyz", sign: float = 1.0) -> DataFrame:
    """Entries of pairs (i, j, r2, d*): -phi * d / r on i and +phi * d / r on j; duplicates summed."""
    lit = F.lit(first_column) if isinstance(first_column, int) else first_column
    r = F.sqrt("r2")
    halves = [F.struct(F.col(site).alias("site_id"), F.lit(n).alias("dim"), ((s * sign) * F.col(f"d{a}") / r).alias("part")) for site, s in (("i", -1.0), ("j", 1.0)) for n, a in enumerate(dims)]
    wide = pairs.withColumn("base", lit).withColumn("b", F.explode(basis)).withColumn("h", F.explode(F.array(*halves)))
    return wide.select("frame_id", "h.site_id", "h.dim", (F.col("base") + F.col("b.idx")).cast("int").alias("col"), (F.col("b.val") * F.col("h.part")).alias("v"))


def site_entries(params: DataFrame, basis: Column, parts: dict[str, tuple[Column, ...]], last: str, first_column: Column | int = 0) -> DataFrame:
    """Entries of angles, dihedrals and the like: phi * gradient of the parameter on each site of `parts`, and minus their sum on `last`.

    phi is a force along the parameter, as for pairs, where it pushes both sites along the slopes of their distance.
    """
    lit = F.lit(first_column) if isinstance(first_column, int) else first_column
    dims = range(len(next(iter(parts.values()))))
    held = params.select("*", *[grad[n].alias(f"_{site}_{n}") for site, grad in parts.items() for n in dims])  # each gradient worked out once
    cells = []
    for n in dims:
        own = [F.col(f"_{site}_{n}") for site in parts]
        cells += [F.struct(F.col(site).alias("site_id"), F.lit(n).alias("dim"), x.alias("part")) for site, x in zip(parts, own, strict=True)]
        cells.append(F.struct(F.col(last).alias("site_id"), F.lit(n).alias("dim"), (-sum(own[1:], own[0])).alias("part")))
    wide = held.withColumn("base", lit).withColumn("h", F.explode(F.array(*cells))).withColumn("b", F.explode(basis))
    return wide.select("frame_id", "h.site_id", "h.dim", (F.col("base") + F.col("b.idx")).cast("int").alias("col"), (F.col("b.val") * F.col("h.part")).alias("v"))


def collected(entries: DataFrame) -> DataFrame:
    """Entries with duplicates summed."""
    return entries.groupBy(*ROW, "col").agg(F.sum("v").alias("v"))


def virial_entries(pairs: DataFrame, basis: Column, first_column: int = 0) -> DataFrame:
    """(frame_id, col, v): sum of phi * r over a frame's pairs; one scalar row for each frame."""
    wide = pairs.withColumn("b", F.explode(basis))
    return wide.groupBy("frame_id", (F.col("b.idx") + first_column).cast("int").alias("col")).agg(F.sum(F.col("b.val") * F.sqrt("r2")).alias("v"))


def targets(sites: DataFrame, axes: tuple[str, ...] = ("fx", "fy", "fz")) -> DataFrame:
    """(frame_id, site_id, dim, f): reference forces, one row for each coordinate."""
    cells = F.array(*[F.struct(F.lit(n).alias("dim"), F.col(a).alias("f")) for n, a in enumerate(axes)])
    return sites.select("frame_id", "site_id", F.explode(cells).alias("t")).select("frame_id", "site_id", "t.dim", "t.f")


def subtract_tabulated(target: DataFrame, entries: DataFrame) -> DataFrame:
    """Targets less the forces of tabulated interactions, given as entries whose v is the table's force."""
    moved = entries.groupBy(*ROW).agg(F.sum("v").alias("known"))
    return target.join(moved, ROW, "left").select(*ROW, (F.col("f") - F.coalesce("known", F.lit(0.0))).alias("f"))


def weighted(df: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Adds the frame's weight; frames that weigh nothing go. weights: (frame_id, weight[, replica])."""
    if weights is None:
        return df.withColumn("weight", F.lit(1.0))
    return df.join(weights.where("weight <> 0"), "frame_id")


def gram_joined(entries: DataFrame, weights: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, v), i <= j: sum of w * a_i * a_j by a self-join on the row. Gives rows as the square of a row's columns."""
    b = entries.select(*[F.col(c).alias(f"{c}_b") for c in ROW], F.col("col").alias("j"), F.col("v").alias("vj"))
    met = entries.join(b, (F.col("frame_id") == F.col("frame_id_b")) & (F.col("site_id") == F.col("site_id_b")) & (F.col("dim") == F.col("dim_b")) & (F.col("col") <= F.col("j")))
    return weighted(met.select("frame_id", F.col("col").alias("i"), "j", (F.col("v") * F.col("vj")).alias("vv")), weights).groupBy(*by, "i", "j").agg(F.sum(F.col("weight") * F.col("vv")).alias("v"))


def gram(entries: DataFrame, target: DataFrame, n_columns: int, weights: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """(i, j, v), i <= j: normal equations, where column n_columns is the target: v of (i, n) is the right side and of (n, n) sum w f^2."""
    both = collected(entries).union(target.select(*ROW, F.lit(n_columns).alias("col"), F.col("f").alias("v")))
    return gram_rows(both, n_columns, weights, chunk=chunk)


def gram_rows(rows: DataFrame, n_columns: int, weights: DataFrame | None = None, by: tuple[str, ...] = (), chunk: int = 4096) -> DataFrame:
    """(by, i, j, v), i <= j: products of the rows (frame_id, site_id, dim, col, v) of [A f], the target being column n_columns.

    Rows are dealt by (by, frame, site), so a row's entries meet; each partition adds up dense blocks of `chunk` rows in
    one (n + 1) squared matrix for the `by` at hand and gives its upper triangle once for each. n_columns bounds a task's
    memory: 2000 takes 32 MB. `by` names integer columns of `weights` (replicas, blocks); a frame's rows are multiplied
    once for each of its weights. Shuffle of the second step is partitions x groups x columns^2 / 2 at most.
    """
    ship(rows.sparkSession)
    n, keys = n_columns, [*by, *ROW]
    dealt = weighted(rows, weights).select(*keys, "col", (F.sqrt("weight") * F.col("v")).alias("v")).repartition(*keys).sortWithinPartitions(*keys)

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, group = np.zeros((n + 1, n + 1)), None

        def triangle() -> pd.DataFrame:
            i, j = np.nonzero(np.triu(total))
            out = pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})
            for k, c in enumerate(by):
                out[c] = np.full(len(out), group[k], np.int64)
            return out[[*by, "i", "j", "v"]]

        def add(part: pd.DataFrame) -> None:
            at, c, v = _numbered(part), part["col"].to_numpy(), part["v"].to_numpy()
            for start in range(0, int(at[-1]) + 1 if len(at) else 0, chunk):
                lo, hi = np.searchsorted(at, [start, start + chunk])
                m = np.zeros((min(chunk, int(at[hi - 1]) - start + 1), n + 1))
                np.add.at(m, (at[lo:hi] - start, c[lo:hi]), v[lo:hi])
                total[...] += m.T @ m

        for part in _whole_rows(parts):
            for own, piece in part.groupby(list(by), sort=True) if by else [((), part)]:
                if group is not None and own != group:
                    yield triangle()
                    total[...] = 0.0
                group = own
                add(piece)
        if group is not None:
            yield triangle()

    kinds = "".join(f"{c} long, " for c in by)
    return dealt.mapInPandas(multiply, f"{kinds}i int, j int, v double").groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def moments(entries: DataFrame, target: DataFrame, weights: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, v): right side r_i = sum of w * a_i * f."""
    return weighted(entries.join(target, ROW), weights).groupBy(*by, F.col("col").alias("i")).agg(F.sum(F.col("weight") * F.col("v") * F.col("f")).alias("v"))


def frame_ranks(frames: DataFrame) -> tuple[DataFrame, int]:
    """((frame_id, k), n): the frames' places 0, 1, ... in order, from a range shuffle and one count for each partition; and their number."""
    spark = frames.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames.select("frame_id").distinct().repartitionByRange(parts, "frame_id").sortWithinPartitions("frame_id").withColumn("at", F.monotonically_increasing_id())
    cut = dealt.checkpoint() if spark.sparkContext.getCheckpointDir() else dealt  # both uses below see the same partitions; the same ranges come anew without it
    part, own = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in cut.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    return cut.join(starts, part == F.col("part")).select("frame_id", (F.col("before") + own).alias("k")), total


def bootstrap_weights(frames: DataFrame, replicas: int, draws: int, seed: int = 1, draw: Column | None = None) -> DataFrame:
    """(replica, frame_id, weight): how often each frame is among `draws` uniform draws with replacement of each replica.

    A draw is the frame at rank hash(seed, replica, draw) modulo the number of frames, or at `draw` (an integer column of
    replica and draw) modulo it. Ranks and draws meet in an equi-join, so neither frames nor draws are ever collected.
    """
    ranks, n = frame_ranks(frames)
    spark = frames.sparkSession
    drawn = spark.range(replicas * draws).select(F.floor(F.col("id") / draws).cast("int").alias("replica"), (F.col("id") % draws).cast("int").alias("draw"))
    number = F.xxhash64(F.lit(seed), "replica", "draw") if draw is None else draw
    counts = drawn.select("replica", F.pmod(number.cast("long"), F.lit(max(n, 1)).cast("long")).alias("k")).groupBy("replica", "k").agg(F.count("*").cast("double").alias("weight"))
    return counts.join(ranks, "k").select("replica", "frame_id", "weight")


def merge_runs(runs: DataFrame) -> DataFrame:
    """(i, j, v): sum of n * v over sum of n, for saved normal equations (run, n, i, j, v) of several runs; a missing entry is 0.

    The equations, runs x columns^2 rows, are read twice, and so kept in the checkpoint folder, where there is one.
    """
    if runs.sparkSession.sparkContext.getCheckpointDir():
        runs = runs.checkpoint()
    total = runs.select("run", "n").distinct().agg(F.sum("n").alias("total"))
    return runs.groupBy("i", "j").agg(F.sum(F.col("n") * F.col("v")).alias("s")).withColumn("total", total.scalar()).select("i", "j", (F.col("s") / F.col("total")).alias("v"))


def residual(triangle: DataFrame, x: DataFrame, n_columns: int) -> DataFrame:
    """One row: x'Gx - 2 x'r + sum f^2 from the augmented triangle of `gram` and a solution (i, x)."""
    y = x.select(F.col("i").alias("at"), "x").union(x.sparkSession.createDataFrame([(n_columns, -1.0)], "at int, x double"))
    a, b = y.select(F.col("at").alias("i"), F.col("x").alias("xi")), y.select(F.col("at").alias("j"), F.col("x").alias("xj"))
    return triangle.join(a, "i").join(b, "j").agg(F.sum(F.col("v") * F.col("xi") * F.col("xj") * F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)).alias("residual"))


def tsqr(entries: DataFrame, target: DataFrame, n_columns: int) -> DataFrame:
    """(i, j, v): the upper triangle R of a QR factorisation of [A f]: partitions factor their rows, then groups of 8 factors are factored, until one is left."""
    ship(entries.sparkSession)
    n = n_columns + 1
    rows = collected(entries).union(target.select(*ROW, F.lit(n_columns).alias("col"), F.col("f").alias("v"))).select(*ROW, "col", "v")

    def factor(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, n))
        for part in _whole_rows(parts):
            at = _numbered(part)
            m = np.zeros((int(at[-1]) + 1, n))
            np.add.at(m, (at, part["col"].to_numpy()), part["v"].to_numpy())
            r = np.linalg.qr(np.vstack([r, m]), mode="r")
        i, j = np.nonzero(r)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": r[i, j]})

    def combine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows_, at = np.unique(group[["part", "i"]].to_numpy(), axis=0, return_inverse=True)
        m = np.zeros((len(rows_), n))
        m[at.ravel(), group["j"]] = group["v"]
        r = np.linalg.qr(m, mode="r")
        i, j = np.nonzero(r)
        return pd.DataFrame({"part": np.full(len(i), key[0], np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": r[i, j]})

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = rows.repartition(parts, *ROW).sortWithinPartitions(*ROW).mapInPandas(factor, "i int, j int, v double").withColumn("part", F.spark_partition_id())
    while parts > 1:  # a task factors 8 (n + 1) rows at most
        now = now.groupBy(F.floor(F.col("part") / 8).cast("int").alias("group")).applyInPandas(combine, "part int, i int, j int, v double")
        parts = -(-parts // 8)
    sign = now.where("i = j").select("i", F.signum("v").alias("sign"))
    return now.join(sign, "i").select("i", "j", (F.col("v") * F.when(F.col("sign") < 0, -1.0).otherwise(1.0)).alias("v"))


def _numbered(part: pd.DataFrame) -> np.ndarray:
    """Numbers from 0 of the matrix rows (equal ROW) in a part sorted by them."""
    keys = part[ROW]
    return np.cumsum((keys != keys.shift()).any(axis=1).to_numpy()) - 1


def _whole_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts of a sorted partition, cut anew so that no matrix row is in two of them."""
    held = None
    for part in parts:
        part = part if held is None else pd.concat([held, part], ignore_index=True)
        if not len(part):
            continue
        last = (part[ROW] == part[ROW].iloc[-1]).all(axis=1)
        held = part[last]
        if not last.all():
            yield part[~last]
    if held is not None and len(held):
        yield held
