"""Order-free keys of interactions: canonical type tuples, dense numbers for them, and readable names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def pair_number(a: Column, b: Column, n_types: int) -> Column:
    """0, 1, ... for unordered pairs of types 1..n, row by row of the upper triangle."""
    i, j = pair_key(a, b)
    return ((i - 1) * n_types + j - 1 - (i * (i - 1) / 2).cast("long")).cast("long")


def ordered_pair_number(home: Column, other: Column, n_types: int) -> Column:
    return ((home - 1) * n_types + other - 1).cast("long")


def triple_key(centre: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    return centre, F.least(a, b), F.greatest(a, b)


def quadruple_key(i: Column, j: Column, k: Column, end: Column) -> tuple[Column, Column, Column, Column]:
    """(i, j, k, end): central types sorted, ends following them; equal central types sort the ends."""
    swap = (i > j) | ((i == j) & (k > end))
    return F.least(i, j), F.greatest(i, j), F.when(swap, end).otherwise(k), F.when(swap, k).otherwise(end)


def name(types: list[Column], sep: str = "_") -> Column:
    return F.concat_ws(sep, *[t.cast("string") for t in types])


def resolve(names: DataFrame, types: DataFrame, col: str = "name") -> DataFrame:
    """Adds type_id to `names`: a type's name, or its number written out; unknown ones get null."""
    known = types.select("type_id", F.col("name").alias("known"))
    by = known.select("type_id", F.explode(F.array_distinct(F.array("known", F.col("type_id").cast("string")))).alias("known"))
    first = by.groupBy("known").agg(F.min("type_id").alias("type_id"))
    return names.join(first, names[col] == first["known"], "left").drop("known")
