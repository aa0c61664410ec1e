"""Embedding near-duplicates by an exact metric range join.

Cosine >= t between unit vectors is Euclidean distance <= r = sqrt(2 - 2 t). Within a label, pivots part the vectors into
cells (nearest pivot). A vector is copied to another cell only if one of that cell's own vectors may be within r of it:
by the triangle inequality its distance to the cell's pivot is then at most the cell's radius + r, and at most its
distance to its own pivot + 2 r; by the hyperplane between the pivots it is within r of that plane. Cells, cut into tiles
of bounded size, join independently.
"""

from __future__ import annotations

import math
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import connected_components, ship, stage, unstage

#: Vectors of a label that meet its pivots together, about: the pivots go to a task once for each such group, not with each vector.
GROUP = 4096
#: Slack on distances for rounding; pairs are confirmed by cosine alone, so it costs candidates and loses none.
EPS = 1e-6


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vec): vec is the double vector over its norm; rows whose vector cannot link, and null ids or labels, are dropped."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    rows = rows.withColumn("top", F.array_max(F.transform("v", lambda x: F.abs(x)))).where("top > 0").withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.select("id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: x / F.col("norm")).alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int):
    import numpy as np

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(len(column), dim) if len(column) else np.zeros((0, dim))


def pivots_of(classes: DataFrame, per_pivot: int | None, most: int, seed: int) -> DataFrame:
    """(label, dim, pivots): vectors of each label taken by a hash of the id: about an eighth of the square root of its number (or one in `per_pivot`), at most `most` and at least one."""
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    wanted = F.sqrt("n") / 8 if per_pivot is None else F.col("n") / per_pivot
    keyed = classes.join(counts.select("label", "dim", (F.least(F.lit(float(most)), wanted) / F.col("n")).alias("share")), ["label", "dim"]).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / float(1 << 53))
    chosen = keyed.where(F.col("u") < F.col("share")).groupBy("label", "dim").agg(F.slice(F.array_sort(F.collect_list(F.struct("u", "id", "vec"))), 1, most).alias("p"))
    some = keyed.groupBy("label", "dim").agg(F.min(F.struct("u", "id", "vec")).alias("one"))
    return some.join(chosen, ["label", "dim"], "left").select("label", "dim", F.transform(F.coalesce("p", F.array("one")), lambda x: x["vec"]).alias("pivots"))


def near_vectors(rows: DataFrame, cosine: float = 0.98, per_pivot: int | None = None, most_pivots: int = 1024, tile: int = 2048, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id, kept for each row of `rows`.

    Rows are compared if their labels are equal and not null; dimensions must be equal too. Null, empty and zero vectors,
    and those with null or non-finite components, link with nothing: n_links 0, themselves their component. A null id
    links with nothing and stays. Equal vectors of a label are one class with a multiplicity; a repeated id is one row
    for links (its smallest vector). A hot label only has more cells, a hot cell more tiles; each tile holds at most
    2 x `tile` vectors and gives sums of links and one edge a vector, never pairs. A label's pivots reach its vectors once
    for each group of about GROUP of them.
    """
    spark = rows.sparkSession
    ship(spark)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + EPS
    units = unit_vectors(rows, id_col, vector_col, label_col).groupBy("id").agg(F.min(F.struct("label", "dim", "vec")).alias("x")).select("id", "x.*")
    units = stage(units.withColumn("key", F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json(F.struct("vec"))), 256)), "units")
    classes = stage(units.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec")).drop("key"), "classes")
    pivots = stage(pivots_of(classes, per_pivot, most_pivots, seed), "pivots")
    label_type = classes.schema["label"].dataType.simpleString()
    salts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    keys = ["label", "dim", "salt"]
    salted = classes.join(salts, ["label", "dim"]).withColumn("salt", F.pmod(F.xxhash64(F.lit(seed + 2), "id"), "salts").cast("int")).drop("salts")

    def each_group(tables: DataFrame) -> DataFrame:
        """A label's row of `tables`, once for each group of its vectors."""
        return tables.join(salts, ["label", "dim"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def distances(left: pa.Table, right: pa.Table):
        import numpy as np

        dim = right.column("dim")[0].as_py()
        x, p = _matrix(left.column("vec"), dim), _matrix(right.column("pivots")[0].values, dim)
        return p, np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        """(label, dim, cell, far): the largest distance to its pivot of each cell's vectors in a group."""
        import numpy as np

        if not left.num_rows or not right.num_rows:
            return left.select(["label", "dim"]).slice(0, 0).append_column("cell", pa.array([], pa.int32())).append_column("far", pa.array([], pa.float64()))
        _, d = distances(left, right)
        far = np.full(d.shape[1], -1.0)
        np.maximum.at(far, d.argmin(1), d.min(1))
        cells = np.flatnonzero(far >= 0)
        head = right.select(["label", "dim"]).take(pa.array(np.zeros(len(cells), np.int64)))
        return head.append_column("cell", pa.array(cells, pa.int32())).append_column("far", pa.array(far[cells], pa.float64()))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each vector in its own cell, and in all others that may hold one of their own vectors within the radius."""
        import numpy as np

        names = ["label", "dim", "cell", "core", "id", "copies", "vec"]
        if not left.num_rows or not right.num_rows:
            none = left.slice(0, 0)
            return pa.table([none.column("label"), none.column("dim"), pa.array([], pa.int32()), pa.array([], pa.bool_()), none.column("id"), none.column("copies"), none.column("vec")], names)
        p, d = distances(left, right)
        own, mine = d.argmin(1), d.min(1)
        far = dict(zip(right.column("cells")[0].as_py(), right.column("fars")[0].as_py(), strict=True))
        reach = np.array([far.get(c, -10.0) for c in range(len(p))])
        between = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * p @ p.T, 0))[own]
        plane = (d * d - (mine * mine)[:, None]) <= 2 * radius * between + EPS
        near = (d <= reach[None] + radius) & (d <= mine[:, None] + 2 * radius) & plane
        near[np.arange(len(d)), own] = True
        row, cell = np.nonzero(near)
        taken = left.take(pa.array(row))
        return pa.table([taken.column("label"), taken.column("dim"), pa.array(cell, pa.int32()), pa.array(own[row] == cell, pa.bool_()), taken.column("id"), taken.column("copies"), taken.column("vec")], names)

    groups = salted.select(*keys, "vec").groupBy(*keys).cogroup(each_group(pivots).groupBy(*keys))
    spans = groups.applyInArrow(measure, f"label {label_type}, dim int, cell int, far double").groupBy("label", "dim", "cell").agg(F.max("far").alias("far"))
    spans = spans.groupBy("label", "dim").agg(F.collect_list("cell").alias("cells"), F.collect_list("far").alias("fars"))  # most_pivots entries at most
    spanned = stage(pivots.join(spans, ["label", "dim"]), "spans")
    groups = salted.select(*keys, "id", "copies", "vec").groupBy(*keys).cogroup(each_group(spanned).groupBy(*keys))
    dealt = stage(groups.applyInArrow(place, f"label {label_type}, dim int, cell int, core boolean, id long, copies long, vec array<double>"), "cells")
    sizes = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.when(F.col("core"), 1)) / tile).cast("int").alias("cores"), F.ceil(F.count("*") / tile).cast("int").alias("alls"))
    tiled = dealt.join(sizes.where("cores > 0"), ["label", "dim", "cell"])
    mine, other = F.pmod(F.xxhash64(F.lit(seed), "id"), "cores").cast("int"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), "alls").cast("int")
    as_core = tiled.where("core").withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("alls") - 1))).withColumn("side", F.lit(True))
    as_any = tiled.withColumn("j", other).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cores") - 1))).withColumn("side", F.lit(False))
    both = as_core.union(as_any.select(as_core.columns)).select("label", "dim", "cell", "i", "j", "side", "id", "copies", "vec")

    def join(t: pa.Table) -> pa.Table:
        import numpy as np

        dim = t.column("dim")[0].as_py()
        side = np.asarray(t.column("side").combine_chunks())
        ids, copies, x = np.asarray(t.column("id")), np.asarray(t.column("copies")), _matrix(t.column("vec"), dim)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        links, edges = np.zeros(len(a), np.int64), _Forest()
        for s in range(0, len(a), 512):
            c = a[s : s + 512]
            close = (x[c] @ x[b].T >= cosine) & (ids[c][:, None] != ids[b][None])
            links[s : s + 512] = close @ copies[b]
            for k in np.flatnonzero(close.any(1)).tolist():
                edges.join(int(ids[c[k]]), ids[b[close[k]]])
        low = edges.edges()
        return pa.table({"id": pa.array(np.concatenate([ids[a], np.array([v for v, _ in low], np.int64)]), pa.int64()), "to": pa.array([None] * len(a) + [r for _, r in low], pa.int64()), "links": pa.array(np.concatenate([links, np.zeros(len(low), np.int64)]), pa.int64())})

    found = stage(both.groupBy("label", "dim", "cell", "i", "j").applyInArrow(join, "id long, to long, links long"), "vector-links")
    for table in (pivots, spanned, dealt, classes):
        unstage(table)
    comps = connected_components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    heads = units.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    members = units.select("id", "key").join(heads, "key").join(links.withColumnRenamed("id", "head"), "head", "left").join(comps.withColumnRenamed("id", "head"), "head", "left")
    members = members.select(F.col("id").alias("linked_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"))
    members = stage(members, "vector-members")
    for table in (units, found, comps):
        unstage(table)
    out = rows.select(F.col(id_col).cast("long").alias("vec_id")).join(members, F.col("vec_id") == F.col("linked_id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


class _Forest:
    """Joins ids and lists (id, smallest id of its part): what the close pairs of a tile join, one edge a vector at most."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, v: int) -> int:
        parent = self.parent
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def join(self, v: int, others) -> None:
        """Joins v with an array of ids; those that v was joined with before cost a look-up."""
        a = self.top(v)
        for w in others.tolist():
            if self.parent.get(w) != a:
                b = self.top(w)
                if a != b:
                    self.parent[max(a, b)] = a = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(v, r) for v in list(self.parent) if (r := self.top(v)) != v]
