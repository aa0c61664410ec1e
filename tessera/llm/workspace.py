"""Shared plumbing: staged tables in the cluster's shared folder, shipping the package to workers, labels, components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

__all__ = ["connected_components", "held_out", "ids_side", "partitions", "shared_dir", "ship", "small_batches", "stage", "table", "unstage"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Unset, it is a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove what `stage` wrote for `df` itself, once all that is made from it has been staged in turn. Other DataFrames have nothing to remove."""
    path = getattr(df, "staged_at", None)
    if path:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


#: Ids up to which a set of ids is broadcast: 16 bytes each, 32 MB in all.
MOST_IDS = 2_000_000


def ids_side(ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """A one-column table of long ids as the small side of a join: broadcast if counted to be at most `most`, else shuffled."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


#: Bytes and rows of the Arrow batches that go to Python workers, where the session sets none: Spark's own bounds are 256 MB and 10,000 rows.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 2_000


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, and bound the Arrow batches that they are sent by bytes."""
    shipping.ship(spark)
    for key, value in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows, so that a worker holds few texts as Python strings at a time; memory that a batch leaves goes back to the system."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the rows that nothing may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


#: Ids that a task joins to components in memory before it lets them go.
BLOCK_IDS = 200_000


def _stars(most: int, names: list[str]):
    """For mapInArrow: reads edges (u, v) and gives an id and its component (`names`) for the ids of each block of them, a block ending at `most` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def closed() -> pa.RecordBatch:
            ids = list(parent)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], names)

        for batch in small_batches(batches, 2_000):
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = top(u), top(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
            if len(parent) >= most:
                yield closed()
                parent.clear()
        yield closed()

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, block: int = BLOCK_IDS) -> DataFrame:
    """(id, component): the smallest id reachable over undirected `edges`, for every id on an edge; staged.

    Each task first reduces its edges to stars in blocks of about `block` ids. Edges counted to fit one block are done by
    that; else large-star and small-star steps alternate on the stars. Each step needs only grouped minima and
    equi-joins, so a hub with millions of neighbours is summed map-side and its join may be split. Each round is staged,
    and removed after the next. Null ends are dropped.
    """
    first = stage(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v"), "cc")
    if 2 * first.limit(block).count() < block:  # an edge has two ids
        out = stage(first.coalesce(1).mapInArrow(_stars(block, ["id", "component"]), "id long, component long"), "cc")
        unstage(first)
        return out
    now = stage(first.mapInArrow(_stars(block, ["u", "v"]), "u long, v long").where("u <> v").distinct(), "cc")
    unstage(first)
    for _ in range(most_rounds):
        roles = now.select(F.col("u").alias("id"), F.lit(1).alias("under"), F.lit(0).alias("over")).union(now.select("v", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
        if roles.where("under > 1 or (under > 0 and over > 0)").limit(1).isEmpty():  # every id hangs on one centre, and no centre on another
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u")
        old, now = now, stage(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        unstage(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    out = stage(out, "cc")
    unstage(now)
    return out
