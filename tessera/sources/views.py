"""The driver's tables as trajectories: sites in frames, molecules with bonds, and frame weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import wrap

#: Box of the embedding sites (each axis), of the molecules, and of the sites on a line.
BOX, MOL_BOX, LINE_BOX = 1.0, (12.0, 12.0, 24.0), 500.0
#: Ids in a frame of embedding sites and of sites on a line: more rows give more frames, not larger ones.
FRAME_SITES, LINE_FRAME_SITES = 100, 400
#: Frames that hold all embedding sites between them, however many there are: frames, and the pairs in them, grow with the table.
WHOLE_FRAMES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str, types: int = 10, whole: bool = False) -> DataFrame:
    """`embeddings` as sites of a periodic unit box: frame = runs of FRAME_SITES ids (`whole`: vec_id % WHOLE_FRAMES), type = label % types + 1, x from components 1-3, f from 4-6."""
    return embedding_sites(table(spark, sf_dir, "embeddings"), types, whole)


def embedding_sites(embeddings: DataFrame, types: int = 10, whole: bool = False) -> DataFrame:
    """The same of a given table or stream."""
    e = F.col("embedding")
    place = [wrap(e[i].cast("double") + 0.5, BOX).alias(c) for i, c in enumerate("xyz")]
    force = [e[i + 3].cast("double").alias(c) for i, c in enumerate(("fx", "fy", "fz"))]
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null")
    frame = F.col("vec_id") % WHOLE_FRAMES if whole else F.floor(F.col("vec_id") / FRAME_SITES)
    return rows.select(frame.cast("int").alias("frame_id"), F.col("vec_id").alias("site_id"), (F.col("label") % types + 1).cast("int").alias("type_id"), *place, *force)


def line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as sites on a periodic line: frame = runs of LINE_FRAME_SITES ids, x = value, wrapped."""
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "search", 4).otherwise(5)
    rows = table(spark, sf_dir, "events").where("event_id is not null and value is not null")
    return rows.select(F.floor(F.col("event_id") / LINE_FRAME_SITES).cast("int").alias("frame_id"), F.col("event_id").alias("site_id"), code.alias("type_id"), wrap(F.col("value"), LINE_BOX).alias("x"))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` by (order, line number) as sites of molecules; the key is not unique in the table, so rows are grouped."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"))
    n = F.col("l_linenumber")
    return rows.select(
        F.col("l_orderkey").alias("mol_id"), n.cast("int").alias("rank"), (F.col("l_orderkey") * 16 + n).alias("site_id"), (n % 3 + 1).cast("int").alias("type_id"),
        wrap(F.col("q") / 10.0, MOL_BOX[0]).alias("x"), wrap(F.col("d") * 40.0 + 1.0, MOL_BOX[1]).alias("y"), wrap(F.col("t") * 40.0 + n * 0.5, MOL_BOX[2]).alias("z"),
    )


def bonds(mol: DataFrame) -> DataFrame:
    """(mol_id, i, j): sites that follow each other in a molecule."""
    w = Window.partitionBy("mol_id").orderBy("rank")
    return mol.select("mol_id", F.lag("site_id").over(w).alias("i"), F.col("site_id").alias("j")).where("i is not null")


def frame_weights(sites: DataFrame) -> DataFrame:
    """(frame_id, weight): a fixed function of the frame; every fifth weighs nothing."""
    return sites.select("frame_id").distinct().select("frame_id", F.when(F.col("frame_id") % 5 == 4, 0.0).otherwise(1.0 + 0.25 * (F.col("frame_id") % 5)).alias("weight"))


# The same views in SQL.
def _wrapped(x: str, side: float) -> str:
    return f"(({x}) - {side} * floor(({x}) / {side}))"


def sites_sql(types: int = 10, whole: bool = False) -> str:
    place = ", ".join(f"{_wrapped(f'embedding[{i + 1}]::DOUBLE + 0.5', BOX)} AS {c}" for i, c in enumerate("xyz"))
    force = ", ".join(f"embedding[{i + 4}]::DOUBLE AS {c}" for i, c in enumerate(("fx", "fy", "fz")))
    frame = f"vec_id % {WHOLE_FRAMES}" if whole else f"vec_id // {FRAME_SITES}"
    return f"sites AS (SELECT ({frame})::INT AS frame_id, vec_id AS site_id, (label % {types} + 1)::INT AS type_id, {place}, {force} FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL)"


LINE_SITES_SQL = f"line_sites AS (SELECT (event_id // {LINE_FRAME_SITES})::INT AS frame_id, event_id AS site_id, (CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'search' THEN 4 ELSE 5 END)::INT AS type_id, {_wrapped('value', LINE_BOX)} AS x FROM events WHERE event_id IS NOT NULL AND value IS NOT NULL)"
MOL_SQL = f"""grouped AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_discount) AS d, min(l_tax) AS t FROM lineitem GROUP BY ALL),
mol AS (SELECT l_orderkey AS mol_id, l_linenumber::INT AS rank, l_orderkey * 16 + l_linenumber AS site_id, (l_linenumber % 3 + 1)::INT AS type_id,
  {_wrapped("q / 10.0::DOUBLE", MOL_BOX[0])} AS x, {_wrapped("d * 40.0::DOUBLE + 1.0::DOUBLE", MOL_BOX[1])} AS y, {_wrapped("t * 40.0::DOUBLE + l_linenumber * 0.5::DOUBLE", MOL_BOX[2])} AS z FROM grouped)"""
BONDS_SQL = "bonds AS (SELECT * FROM (SELECT mol_id, lag(site_id) OVER (PARTITION BY mol_id ORDER BY rank) AS i, site_id AS j FROM mol) WHERE i IS NOT NULL)"
WEIGHTS_SQL = "weights AS (SELECT frame_id, CASE WHEN frame_id % 5 = 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + 0.25::DOUBLE * (frame_id % 5) END AS weight FROM (SELECT DISTINCT frame_id FROM sites))"
