"""The registered queries of the engine and their oracle SQL. Modules of this package add theirs with `query`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with DuckDB SQL for the same rows where there is some."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six digits the same way in both dialects.

    Spark's floor gives a long, which would stop at 2^63 and make NaN 0; from 2^53 on a double has no fraction to drop.
    """
    c = F.col(c) if isinstance(c, str) else c
    moved = c * 1e6 + 0.5
    return F.when(F.abs(moved) < 2.0**53, F.floor(moved) / 1e6).otherwise(moved / 1e6)


def q6(c: str) -> str:
    return f"floor(({c}) * 1e6 + 0.5) / 1e6"


def eliminated(source: str, n: int, by: str = "", diagonal: str = "0.0") -> str:
    """CTEs ending in x(by, col, x): Gauss-Jordan elimination, one column a step, of the augmented upper triangle `source` (by, i, j, v); `diagonal` (of i) is added."""
    key, first, per = (f"{by}, ", f"{by}, ", f"PARTITION BY {by}") if by else ("", "", "")
    same = f"AND f.{by} = t.{by}" if by else ""
    keys = f"(SELECT DISTINCT {by} FROM {source}) k, " if by else ""
    return f"""halves AS (SELECT {key}i, j, v FROM {source} WHERE i < {n} UNION ALL SELECT {key}j, i, v FROM {source} WHERE j < {n} AND i < j),
full_square AS (SELECT {'k.' + by + ', ' if by else ''}a.i, b.j FROM {keys}range(0, {n}) a(i), range(0, {n + 1}) b(j)),
filled AS (SELECT {'f.' + by + ', ' if by else ''}f.i, f.j, coalesce(t.v, 0) + CASE WHEN f.i = f.j THEN {diagonal.format(i='f.i')} ELSE 0 END AS v FROM full_square f LEFT JOIN halves t ON t.i = f.i AND t.j = f.j {same}),
lines AS (SELECT {first}i, list(v ORDER BY j) AS line FROM filled GROUP BY {first}i),
start AS (SELECT {first}list(line ORDER BY i) AS m FROM lines {'GROUP BY ' + by if by else ''}),
steps AS (SELECT {first}1 AS k, m FROM start UNION ALL
  SELECT {first}k + 1, list_transform(m, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda x: x / line[k]) ELSE list_transform(line, lambda x, j: x - line[k] * m[k][j] / m[k][k]) END) FROM steps WHERE k <= {n}),
x AS (SELECT {first}(c - 1)::INT AS col, m[c][{n + 1}] AS x FROM steps, range(1, {n + 1}) t(c) WHERE k = {n + 1})"""


def _load() -> None:
    from . import fitting, geometry, models, ordered, relations  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
