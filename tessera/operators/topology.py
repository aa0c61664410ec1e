"""Bonded topology as relations: angles and dihedrals inferred from bonds, exclusions, and what bonds can reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def directed(bonds: DataFrame) -> DataFrame:
    """(a, b) for both directions of each bond, without repeats and self-bonds."""
    both = bonds.select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e"))
    return both.select("e.a", "e.b").where("a <> b").distinct()


def angles(bonds: DataFrame) -> DataFrame:
    """(k, j, l): ends k < l of every two bonds that share the centre j."""
    d = directed(bonds)
    x, y = d.select(F.col("a").alias("j"), F.col("b").alias("k")), d.select(F.col("a").alias("j"), F.col("b").alias("l"))
    return x.join(y, "j").where("k < l").select("k", "j", "l")


def dihedrals(bonds: DataFrame) -> DataFrame:
    """(k, i, j, l): every path of three bonds over four different sites, about the central bond i < j."""
    d = directed(bonds)
    centre = d.where("a < b").select(F.col("a").alias("i"), F.col("b").alias("j"))
    x, y = d.select(F.col("a").alias("i"), F.col("b").alias("k")), d.select(F.col("a").alias("j"), F.col("b").alias("l"))
    return centre.join(x, "i").where("k <> j").join(y, "j").where("l <> i and l <> k").select("k", "i", "j", "l")


#: Bonds that a task holds at a time while it joins its own into stars.
HELD_BONDS = 4_000_000


def _stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, root) of every site of the bonds at hand: root is the smallest site that these bonds reach."""

    def joined(held: list[pd.DataFrame]) -> pd.DataFrame:
        bonds = pd.concat(held, ignore_index=True)
        ids, at = np.unique(np.concatenate([bonds["i"].to_numpy(), bonds["j"].to_numpy()]), return_inverse=True)
        a, b = at[: len(bonds)], at[len(bonds) :]
        label = np.arange(len(ids))
        while True:  # labels hook onto smaller ones over each bond and are then replaced by their own labels
            least, now = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(now, label[a], least)
            np.minimum.at(now, label[b], least)
            now = now[now]
            if (now == label).all():
                return pd.DataFrame({"id": ids, "root": ids[label]})
            label = now

    held, n = [], 0
    for part in parts:
        if len(part):
            held.append(part)
            n += len(part)
        if n >= HELD_BONDS:
            yield joined(held)
            held, n = [], 0
    if held:
        yield joined(held)


def reachable(bonds: DataFrame, most_rounds: int = 40, checkpoint: bool = True) -> DataFrame:
    """(id, molecule): the smallest site that bonds reach, for each bonded site.

    Each task joins its own bonds into stars about their smallest sites. Sites with one root over all tasks are done;
    only links between the roots that other sites share go through rounds (`closure`), so bonds that lie beside those
    of their molecule cost one pass. Cut with a reliable checkpoint where the session has a checkpoint folder.
    """
    spark = bonds.sparkSession
    ship(spark)
    cut = checkpoint and spark.sparkContext.getCheckpointDir() is not None
    ends = bonds.where("i <> j").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    roots = ends.mapInPandas(_stars, "id long, root long").groupBy("id").agg(F.min("root").alias("molecule"), F.collect_set("root").alias("roots"))
    found = roots.select("id", "molecule", F.when(F.size("roots") > 1, F.col("roots")).alias("roots"))
    found = found.checkpoint() if cut else found.persist()
    links = found.where("roots is not null").select(F.col("molecule").alias("i"), F.explode("roots").alias("j"))
    if links.isEmpty():
        return found.select("id", "molecule")
    further = closure(links, most_rounds, checkpoint).select(F.col("id").alias("molecule"), F.col("molecule").alias("further"))
    return found.select("id", "molecule").join(further, "molecule", "left").select("id", F.coalesce("further", "molecule").alias("molecule"))


def closure(bonds: DataFrame, most_rounds: int = 40, checkpoint: bool = True) -> DataFrame:
    """(id, molecule): the smallest site that bonds reach, for each bonded site.

    Minimum labels spread over bonds, and each label is then replaced by its own label's label (pointer jumping), so the
    number of rounds grows with the logarithm of a molecule's length. Each round is cut with a reliable checkpoint
    where the session has a checkpoint folder. Raises RuntimeError if labels still change after `most_rounds`.
    """
    spark = bonds.sparkSession
    cut = checkpoint and spark.sparkContext.getCheckpointDir() is not None
    d = directed(bonds)
    d = d.checkpoint() if cut else d
    now = d.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("molecule"))
    before, held = None, []
    for _ in range(most_rounds):
        spread = d.join(now.select(F.col("id").alias("b"), "molecule"), "b").groupBy(F.col("a").alias("id")).agg(F.min("molecule").alias("m"))
        near = now.join(spread, "id").select("id", F.least("molecule", "m").alias("molecule"))
        jump = near.select(F.col("id").alias("molecule"), F.col("molecule").alias("further"))
        now = near.join(jump, "molecule").select("id", F.col("further").alias("molecule"))
        now = now.checkpoint() if cut else now.persist()
        held.append(now)
        mark = now.agg(F.sum(F.col("molecule").cast("decimal(38,0)"))).first()[0]  # labels only fall, so an equal sum is the same labels; wide enough for any ids
        for old in [] if cut else held[:-1]:
            old.unpersist()
        held = held[-1:]
        if mark == before:
            return now
        before = mark
    raise RuntimeError(f"molecules did not settle in {most_rounds} rounds")


def exclusions(bonds: DataFrame, style: int) -> DataFrame:
    """(i, j), i < j. Style 0: none; 2: bonded; 3: and ends of angles; 4: and ends of dihedrals; 5: all that bonds connect."""
    one = bonds.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i <> j")
    if style == 0:
        return one.where("false")
    if style == 5:  # pairs within molecules, as the square of a molecule's size: to leave them out of neighbours, use neighbors.outside_molecules
        m = reachable(bonds)
        return m.select(F.col("id").alias("i"), "molecule").join(m.select(F.col("id").alias("j"), "molecule"), "molecule").where("i < j").select("i", "j")
    if style not in (2, 3, 4):
        raise ValueError(f"unknown exclusion style {style}")
    out = one
    if style >= 3:
        out = out.union(angles(bonds).select(F.col("k").alias("i"), F.col("l").alias("j")))
    if style >= 4:
        out = out.union(dihedrals(bonds).select(F.least("k", "l").alias("i"), F.greatest("k", "l").alias("j")))
    return out.distinct()


def replicate(template: DataFrame, copies: int, sites: int, columns: tuple[str, ...], start: int = 0) -> DataFrame:
    """Copies of a molecule template's site numbers, each moved on by the template's number of sites."""
    many = template.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 0 else template.withColumn("copy", F.lit(0)).where("false")
    return many.select(*[(F.col(c) + start + F.col("copy") * sites if c in columns else F.col(c)).alias(c) for c in template.columns])
