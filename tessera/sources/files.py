"""Readers of trajectories and run files, and frame-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def frame_window(sites: DataFrame, start: int, count: int) -> DataFrame:
    """Frames start .. start + count - 1; with frame_id a partition column this prunes files."""
    return sites.where((F.col("frame_id") >= start) & (F.col("frame_id") < start + count))


def sample_states(sites: DataFrame, samples: int, uniform: Column | None = None, seed: int = 1) -> DataFrame:
    """Each site `samples` times (sample 1, 2, ...): type 1 if a uniform draw is at most state_p, else type 2.

    The draw is hashed from (seed, frame, site, sample) unless a column in [0, 1] is given; it may use `sample`.
    """
    many = sites.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "frame_id", "site_id", "sample"), 11) / float(1 << 53) if uniform is None else uniform
    return many.withColumn("type_id", F.when(u <= F.col("state_p"), 1).otherwise(2))


#: File splits whose first numbers are broadcast: under 200 bytes each. Beyond it they are joined by a shuffle.
MOST_SPLITS = 200_000


def _records(lines: DataFrame) -> DataFrame:
    """(value, file, start, at) of a text source: which file and which split of it a record is from, and its order there."""
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def _numbered(records: DataFrame) -> DataFrame:
    """(value, file, k): the numbers 1, 2, ... of `_records`, over all files in order of path names.

    Records of a split are numbered in order; the splits' first numbers come from one window over a row for each split.
    """
    splits = records.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    firsts = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    side = F.broadcast(firsts) if splits.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS else firsts
    return records.join(side, ["file", "start"]).select("value", "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("k"))


def read_dump(spark: SparkSession, path: str, dim: int = 3, no_forces: bool = False) -> DataFrame:
    """A LAMMPS text dump as one row for each atom line: frame_id, timestep, box lengths lx.., site_id, type_id, state_p, x.., fx...

    The text is cut at `ITEM: TIMESTEP` by the reader itself, so that a file may be split between tasks; memory is one
    frame for a task. Columns are found by the names in `ITEM: ATOMS`. frame_id counts from 1 over all files, in order
    of path names. Positions are less the box origin and wrapped into the box; site_id is the atom's place in the frame,
    from 0. A line with too few fields, or a number of atom lines other than stated, gives the row `problem`.
    """
    cut = spark.read.option("lineSep", "ITEM: TIMESTEP").text(path).where(F.trim(F.translate("value", "\r\n", "  ")) != "")
    frames = _numbered(_records(cut)).select("file", F.col("k").cast("int").alias("k"), F.regexp_replace(F.regexp_replace("value", "\r", ""), "^\\s*\n", "").alias("body"))
    part = lambda name: F.regexp_extract("body", rf"ITEM: {name}[^\n]*\n([^I]*)", 1)
    bounds = F.transform(F.slice(F.split(F.trim(F.regexp_extract("body", r"ITEM: BOX BOUNDS[^\n]*\n([^I]*)", 1)), "\n"), 1, dim), lambda b: F.transform(F.slice(F.split(F.trim(b), r"\s+"), 1, 2), lambda x: x.cast("double")))
    header = F.split(F.trim(F.regexp_extract("body", r"ITEM: ATOMS([^\n]*)\n", 1)), r"\s+")
    atoms = F.filter(F.split(F.regexp_extract("body", r"ITEM: ATOMS[^\n]*\n([\s\S]*)", 1), "\n"), lambda x: F.trim(x) != "")
    frames = frames.select("file", F.col("k").cast("int").alias("frame_id"), F.trim(F.split("body", "\n")[0]).try_cast("long").alias("timestep"), part("NUMBER OF ATOMS").alias("stated"), bounds.alias("bounds"), header.alias("header"), atoms.alias("atoms"))
    rows = frames.select("*", F.posexplode("atoms").alias("site", "line")).withColumn("fields", F.split(F.trim("line"), r"\s+"))

    def number(name: str) -> Column:
        at = F.array_position("header", name)
        return F.when(at > 0, F.try_element_at("fields", at.cast("int")).try_cast("double"))

    axes = "xyz"[:dim]
    place = []
    for n, a in enumerate(axes):
        low, side = F.col("bounds")[n][0], F.col("bounds")[n][1] - F.col("bounds")[n][0]
        place.append((number(a) - low - side * F.floor((number(a) - low) / side)).alias(a))
    forces = [] if no_forces else [number(f"f{a}").alias(f"f{a}") for a in axes]
    kind = F.array_position("header", "type")
    problem = F.when(F.size("fields") < F.size("header"), "too few fields").when(F.trim("stated").try_cast("long") != F.size("atoms"), "wrong number of atoms")
    return rows.select(
        "file", "frame_id", "timestep", *[(F.col("bounds")[n][1] - F.col("bounds")[n][0]).alias(f"l{a}") for n, a in enumerate(axes)], F.col("site").alias("site_id"),
        F.when(kind > 0, F.try_element_at("fields", kind.cast("int")).try_cast("int")).alias("type_id"), number("state").alias("state_p"), *place, *forces, problem.alias("problem"),
    )


def zip_positions_forces(positions: DataFrame, forces: DataFrame) -> DataFrame:
    """Two trajectories of one run, positions in one and forces in the other, joined on (frame, site)."""
    return positions.join(forces, ["frame_id", "site_id"])


def check_sites(sites: DataFrame) -> DataFrame:
    """(frame_id, n) of frames whose number of sites is not that of the first frame; empty if all agree."""
    n = sites.groupBy("frame_id").agg(F.count("*").alias("n"))
    first = n.agg(F.min_by("n", "frame_id").alias("n"))
    return n.where(F.col("n") != first.scalar())


def read_frame_values(spark: SparkSession, path: str, name: str, start: int = 1) -> DataFrame:
    """(frame_id, <name>): one number a line (frame weights, virial targets), blank lines left out; frame ids start at `start`, with the line of that number."""
    lines = _numbered(_records(spark.read.text(path).where(F.trim("value") != "")))
    return lines.where(F.col("k") >= start).select(F.col("k").cast("int").alias("frame_id"), F.trim("value").try_cast("double").alias(name))
