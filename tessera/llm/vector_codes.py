"""Vector codes by product quantisation whose codebooks are kept by deltas.

Vectors become integers, are cut into equal parts, and each part is assigned to the nearest entry of its position's
codebook. The assignments of a round are persisted beside the vectors, and every entry keeps a running integer sum and
count of its parts. A round compares new with persisted assignments and shuffles, for the parts that moved alone, a
minus to the entry they left and a plus to the one they came to, added up within tasks first. Integers make the running
sums equal to sums made anew, in any order of tasks and after any retry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import ids_side, ship, stage, unstage

__all__ = ["code_vectors", "contributions", "nearest", "split_parts"]

#: Integer components beyond this could make a squared distance overflow 64 bits.
LARGEST = 1 << 27
#: Copies of each label's total, over which rows of one label are dealt when totals are too many to broadcast.
SALTS = 32


def split_parts(flat: np.ndarray, rows: int, parts: int) -> np.ndarray:
    """(rows, parts, components) of int64."""
    return flat.reshape(rows, parts, -1)


def nearest(vectors: np.ndarray, books: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry by row and part; ties go to the lower index. `books`: (parts, entries, components)."""
    rows, parts, width = vectors.shape
    index, far = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), np.int64)
    step = max(1, most // max(1, books.shape[1] * width))
    for p in range(parts):
        for at in range(0, rows, step):
            d = ((vectors[at : at + step, p, None, :] - books[p][None, :, :]) ** 2).sum(axis=2)
            index[at : at + step, p] = d.argmin(axis=1)
            far[at : at + step, p] = np.take_along_axis(d, index[at : at + step, p, None], 1)[:, 0]
    return index, far


def contributions(vectors: np.ndarray, before: np.ndarray, after: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed sums (parts, entries, components) and counts of the parts whose assignment changed; `before` is -1 where there was none."""
    rows, parts, width = vectors.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        moved = np.flatnonzero(before[:, p] != after[:, p])
        old = moved[before[moved, p] >= 0]
        for which, at, sign in ((after, moved, 1), (before, old, -1)):
            np.add.at(sums[p], which[at, p], sign * vectors[at, p])
            np.add.at(counts[p], which[at, p], sign)
    return sums, counts


def _usable(vectors: DataFrame, vec_col: str, label_col: str, id_col: str, parts: int) -> tuple[DataFrame, int]:
    """Rows (vec_id, label, q: integer components) of the commonest length that `parts` divides, and that length (0: no rows)."""
    v = F.col("v")
    finite = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    finite = finite.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = finite.groupBy(F.size("v").alias("n")).count().where(f"n > 0 and n % {parts} = 0").orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = sizes[0]["n"] if sizes else 0
    whole = F.transform(v, lambda x: F.when(F.abs(x) < LARGEST / 256, F.floor(256 * x).cast("int")).otherwise(F.raise_error(F.lit(f"components of {LARGEST // 256} and more are beyond exact squared distances"))))
    return finite.where(F.size("v") == width if width else F.lit(False)).select("vec_id", "label", whole.alias("q")), width


def _assign(books: np.ndarray, names: list[str]):
    """For mapInArrow over (vec_id, label, q, code): the row with its code as `before`, the new one as `code`, and the error."""
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                v = split_parts(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64), n, parts)
                index, far = nearest(v, books)
                codes = pa.array([row.tobytes() for row in index.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], codes, pa.array(far.sum(axis=1))], names)

    return run


def _deltas(parts: int, entries: int, width: int):
    """For mapInArrow over (q, before, code): this task's signed sums by part and entry, entries without a change left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, touched = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries), bool)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = split_parts(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64), n, parts)
            before = np.array([[-1] * parts if b is None else list(b) for b in batch.column(1).to_pylist()])
            after = np.array([list(b) for b in batch.column(2).to_pylist()])
            s, c = contributions(v, before, after, entries)
            sums += s
            counts += c
            touched |= (c != 0) | (s != 0).any(axis=2)
        part, entry = np.nonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(list(sums[part, entry]), pa.list_(pa.int64())), pa.array(counts[part, entry])], ["part", "entry", "sums", "n"])

    return run


def code_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each usable vector: vec_id, code, error, label_error, codebooks_sha256, label.

    Components become floor(256 * x). `entries` (at most 256) first vectors by id give each part's first codebook; null
    ids come last and begin no codebook. Each of `rounds` rounds assigns and then replaces every entry that has parts by
    the floored mean of them; a last assignment gives `code` (two hex digits a part) and `error`. `label_error` sums the
    errors of equal labels, nulls together.

    Vectors that are null or hold null or non-finite components are left out, as are those of another length than the
    commonest that `parts` divides (ties: the longer). Repeated ids are vectors of their own, ordered by their
    components where the first ones are taken. Components of 2^19 and more raise an error, as their squared distances
    would not fit in 64 bits. No usable vectors: no rows. With fewer than `entries` ids the codebooks are that short; with
    none (all null) codes cannot be made, and the ids count as equal instead.

    What is driver-side is one codebook: parts x entries x components. A round writes the vectors with their
    assignments to the shared folder (no shuffle), and shuffles at most parts x entries rows of each task.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    usable, size = _usable(vectors, vec_col, label_col, id_col, parts)
    wide = f"vec_id {usable.schema['vec_id'].dataType.simpleString()}, label {usable.schema['label'].dataType.simpleString()}, q array<int>"
    if not size:
        return spark.createDataFrame([], f"{wide.split(', label')[0]}, code string, error long, label_error long, codebooks_sha256 string, label {usable.schema['label'].dataType.simpleString()}")
    width = size // parts
    now = stage(usable.withColumn("code", F.lit(None).cast("binary")), "codes")
    first = now.where("vec_id is not null").orderBy("vec_id", "q").limit(entries).collect() or now.orderBy("q").limit(entries).collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    names = ["vec_id", "label", "q", "before", "code", "error"]
    for k in range(rounds + 1):
        old, now = now, stage(now.select("vec_id", "label", "q", "code").mapInArrow(_assign(books, names), f"{wide}, before binary, code binary, error long"), "codes")
        unstage(old)
        if k == rounds:
            break
        moved = now.where(~F.col("before").eqNullSafe(F.col("code"))).select("q", "before", "code").mapInArrow(_deltas(*books.shape), "part long, entry long, sums array<long>, n long")
        added = moved.groupBy("part", "entry").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"), F.sum("n").alias("n"))
        for r in added.collect():  # at most one row for each entry
            sums[r["part"], r["entry"]] += np.array(r["sums"], np.int64)
            counts[r["part"], r["entry"]] += r["n"]
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    totals = stage(now.groupBy("label").agg(F.sum("error").alias("label_error")), "code-labels")
    side = ids_side(totals)
    rows = now.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.col("label").alias("own"))
    if side is totals:  # too many to broadcast: deal each label's rows over copies of its total
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        side = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
        out = rows.join(side, rows["own"].eqNullSafe(side["label"]) & (rows["salt"] == side["salt"]))
    else:
        out = rows.join(side, rows["own"].eqNullSafe(totals["label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), F.col("own").alias("label"))
