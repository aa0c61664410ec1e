"""A factor that grows with a stream: the triangle R of all frames so far, kept as state, frames in any order and once each.

Each run's frames are dealt over shards, so that no run is one task's work; a shard's state is its R factor (columns + 1
squared), the frames it has taken, and the latest frame's box. State lives in the state store beside the stream's
checkpoint: a restarted query goes on where it stopped, and a frame that is delivered again changes nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run long, shard int, frames long, last_frame long, box array<double>, r array<double>"


class FactorState(StatefulProcessor):
    """Folds the new frames' rows of [A f] into R. A shard's share of one micro-batch is held in memory."""

    def __init__(self, n_columns: int):
        self.n = n_columns + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.factor = handle.getValueState("factor", "r binary, frames long, last_frame long, box array<double>")
        self.seen = handle.getMapState("seen", "frame_id long", "rows long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows), ignore_index=True)
        frames = [f for f in sorted(set(got["frame_id"].tolist())) if not self.seen.containsKey((f,))]
        raw, taken, last, box = self.factor.get() if self.factor.exists() else (None, 0, None, None)
        r = np.frombuffer(raw, float).reshape(self.n, self.n) if raw is not None else np.zeros((self.n, self.n))
        for f in frames:
            part = got[got["frame_id"] == f]
            at = pd.factorize(pd.MultiIndex.from_frame(part[["site_id", "dim"]]))[0]
            m = np.zeros((int(at.max()) + 1, self.n))
            np.add.at(m, (at, part["col"].to_numpy()), part["v"].to_numpy())
            stacked = np.linalg.qr(np.vstack([r, m]), mode="r")
            r = np.zeros((self.n, self.n))
            r[: len(stacked)] = stacked
            self.seen.updateValue((f,), (len(part),))
            if last is None or f >= last:
                last, box = f, [float(x) for x in part["box"].iloc[0]]
        taken += len(frames)
        if frames:
            self.factor.update((r.tobytes(), taken, last, box))
        yield pd.DataFrame({"run": [key[0]], "shard": [key[1]], "frames": [taken], "last_frame": [last], "box": [list(box)], "r": [r.ravel().tolist()]})

    def close(self) -> None:
        pass


def run_factors(rows: DataFrame, n_columns: int, folder: str, checkpoint: str, shards: int = 8, available_now: bool = True) -> StreamingQuery:
    """Starts a query over a stream of rows (run, frame_id, site_id, dim, col, v, box array<double>) of [A f], the target being column n_columns.

    A frame's rows must arrive in one micro-batch (one file a frame, say), in any order of frames; a frame id that was
    taken before is left out, whatever its rows. Each micro-batch writes the shards that it touched to
    folder/batch=<number>; delivered again, it overwrites its own.
    """
    spark = rows.sparkSession
    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stream's own driver-side worker does not see what `ship` sends
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed = rows.select(F.col("run").cast("long").alias("run"), F.pmod(F.xxhash64("frame_id"), F.lit(shards)).cast("int").alias("shard"), F.col("frame_id").cast("long").alias("frame_id"), "site_id", "dim", "col", "v", "box")
    made = keyed.groupBy("run", "shard").transformWithStateInPandas(FactorState(n_columns), OUT, "Update", "None")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # read when the query starts; this kind of state needs it
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(run, shard, frames, last_frame, box, r): each shard's state after its last batch so far."""
    parts = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    newest = F.max_by(F.struct("frames", "last_frame", "box", "r"), "batch")
    return parts.groupBy("run", "shard").agg(newest.alias("s")).select("run", "shard", "s.*")


def merged_triangle(spark: SparkSession, folder: str, n_columns: int) -> DataFrame:
    """(run, i, j, v), i <= j: normal equations of all frames so far: the sum over shards of R'R."""
    ship(spark)
    n = n_columns + 1

    def squared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for run, flat in zip(part["run"], part["r"], strict=True):
                r = np.asarray(flat, float).reshape(n, n)
                i, j = np.nonzero(np.triu(r.T @ r))
                yield pd.DataFrame({"run": run, "i": i.astype(np.int32), "j": j.astype(np.int32), "v": (r.T @ r)[i, j]})

    return latest(spark, folder).select("run", "r").mapInPandas(squared, "run long, i int, j int, v double").groupBy("run", "i", "j").agg(F.sum("v").alias("v"))


def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """(run, frames, last_frame, box): frames taken so far and the box of the latest."""
    return latest(spark, folder).groupBy("run").agg(F.sum("frames").alias("frames"), F.max("last_frame").alias("last_frame"), F.max_by("box", "last_frame").alias("box"))
