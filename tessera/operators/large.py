"""Normal equations with too many columns for one process: conjugate gradients over relational entries.

The matrix stays a table (i, j, v) and a vector a table with one row for each column. A round is one equi-join of the
entries with the search direction, partial sums by row, and two scalars to the driver. Rounds are written to the folder
in `spark.checkpoint.dir`, so a lost executor costs one round, and no plan grows with the number of rounds.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import solve

#: Rows up to which a vector is broadcast to the entries: 16 bytes each, 32 MB in all. Beyond it the join shuffles.
MOST_BROADCAST = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names, which driver and executors share. Unset, it is a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def symmetric(triangle: DataFrame) -> DataFrame:
    """(i, j, v) with both halves, from an upper triangle i <= j."""
    other = F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return triangle.select(F.explode(F.when(F.col("i") == F.col("j"), F.slice(other, 1, 1)).otherwise(other)).alias("e")).select("e.i", "e.j", "e.v")


def product(matrix: DataFrame, vector: DataFrame, n_columns: int) -> DataFrame:
    """(i, q): a square table times a vector (j, p). Entries of a row are summed in their tasks before the shuffle."""
    side = F.broadcast(vector) if n_columns <= MOST_BROADCAST else vector
    return matrix.join(side, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("p")).alias("q"))


def conjugate_gradient(triangle: DataFrame, n_columns: int, ridge: float = 0.0, diagonal: DataFrame | None = None, tolerance: float = 1e-10, most_rounds: int | None = None) -> DataFrame:
    """(col, x) solving G x = r, from the augmented upper triangle (i, j, v) of `normal.gram`; columns from 0 to n_columns - 1.

    `diagonal` (col, d) is added to G. `ridge` adds ridge^2 times the norm of G's column to its diagonal, which is what
    ridge^2 on the diagonal after column scaling amounts to. The search is preconditioned by the diagonal. It ends when
    the residual is below `tolerance` times the right side, both scaled by the square root of the diagonal's inverse;
    RuntimeError if it does not within `most_rounds` (default: four times the columns, 50 at least).

    Columns without entries get 0, and so does everything if the right side is 0. A singular but consistent system gets
    the solution that the search reaches from 0. Memory is that of one partition; the driver sees two numbers a round.
    """
    spark = triangle.sparkSession
    base = shared_folder(spark)
    try:
        whole = symmetric(triangle.where((F.col("i") < n_columns) & (F.col("j") < n_columns)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v"))
        matrix = _written(whole.groupBy("i", "j").agg(F.sum("v").alias("v")), f"{base}/matrix")
        right = triangle.where((F.col("j") == n_columns) & (F.col("i") < n_columns)).groupBy(F.col("i").cast("long").alias("i")).agg(F.sum("v").alias("r"))
        size = matrix.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("own"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        rows = spark.range(n_columns).withColumnRenamed("id", "i").join(size, "i", "left").join(right, "i", "left")
        if diagonal is not None:
            rows = rows.join(diagonal.select(F.col("col").cast("long").alias("i"), "d"), "i", "left")
        added = F.coalesce(F.col("d") if diagonal is not None else F.lit(None).cast("double"), F.lit(0.0)) + ridge**2 * F.coalesce("norm", F.lit(0.0))
        rows = rows.withColumn("added", added).withColumn("whole", F.coalesce("own", F.lit(0.0)) + F.col("added"))
        inverse = F.when(F.col("whole") > 0, 1 / F.col("whole")).otherwise(0.0)
        left = F.when(F.col("whole") > 0, F.coalesce("r", F.lit(0.0))).otherwise(0.0)
        state = _written(rows.select("i", "added", inverse.alias("h"), F.lit(0.0).alias("x"), left.alias("res"), (left * inverse).alias("p")), f"{base}/state")
        rho = state.agg(F.sum(F.col("res") * F.col("res") * F.col("h"))).first()[0] or 0.0
        goal = tolerance**2 * rho
        for k in range(most_rounds if most_rounds is not None else max(50, 4 * n_columns)):
            if rho <= goal or rho == 0.0:
                break
            q = product(matrix, state.select(F.col("i").alias("j"), "p"), n_columns)
            met = state.join(q, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0)) + F.col("added") * F.col("p"))
            path = f"{base}/round-{k}"
            met = _written(met, path)
            curve = met.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
            if not curve > 0:
                break  # the direction is in the null space: what is left of the residual cannot be fitted
            alpha = rho / curve
            left = F.col("res") - alpha * F.col("q")
            before, rho = rho, met.agg(F.sum(left * left * F.col("h"))).first()[0]
            state = met.select("i", "added", "h", (F.col("x") + alpha * F.col("p")).alias("x"), left.alias("res"), (left * F.col("h") + (rho / before) * F.col("p")).alias("p"))
            if k > 1:
                _remove(spark, f"{base}/round-{k - 2}")
        else:
            if rho > goal:
                raise RuntimeError(f"residual is {math.sqrt(rho / goal) * tolerance:.1e} of the right side after the last round")
        return _written(state.select(F.col("i").cast("int").alias("col"), "x"), f"{base}-solution")
    finally:
        _remove(spark, base)


def solution(triangle: DataFrame, n_columns: int, ridge: float = 0.0, diagonal: DataFrame | None = None, rcond: float = -1.0, tolerance: float = 1e-10) -> DataFrame:
    """(col, x): least squares of normal equations of any size, dense on the driver up to solve.MOST_COLUMNS columns, else by conjugate gradients."""
    if n_columns > solve.MOST_COLUMNS:
        return conjugate_gradient(triangle, n_columns, ridge, diagonal, tolerance)
    import numpy as np

    g, r, _ = solve.dense(triangle, n_columns)
    extra = None
    if diagonal is not None:
        extra = np.zeros(n_columns)
        for row in diagonal.collect():  # n_columns rows at most
            extra[row["col"]] = row["d"]
    x, _ = solve.solve(g, r, rcond, ridge, extra)
    return triangle.sparkSession.createDataFrame([(k, float(c)) for k, c in enumerate(x)], "col int, x double")
