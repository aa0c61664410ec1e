"""Spline bases as SQL expressions: linear (hat), and B-splines of any order by the polynomials of their spans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AXIS_EPS

ENTRY = "array<struct<idx:int,val:double>>"


def clamp(p: Column, lo: Column | float, hi: Column | float, tiny: float = 1e-14) -> Column:
    """p - lo, kept within [0, hi - lo)."""
    return F.least(F.greatest(p - lo, F.lit(0.0)), F.lit(hi) - lo - tiny if not isinstance(hi, Column) else hi - lo - tiny)


def hat(p: Column, lo: Column | float, hi: Column | float, width: Column | float) -> Column:
    """Two (idx, val) entries of the linear basis: weights 1 - f and f on the knots around p."""
    at = clamp(p, lo, hi) / width
    b = F.floor(at).cast("int")
    f = at - F.floor(at).cast("double")
    return F.array(F.struct(b.alias("idx"), (1 - f).alias("val")), F.struct((b + 1).alias("idx"), f.alias("val")))


def hat_value(rows: DataFrame, p: Column, coefficients: list[float], lo: float, hi: float, width: float) -> DataFrame:
    """The rows with `value`: the linear spline of these coefficients at p. A row needs no other, so nothing is shuffled."""
    c = F.lit([float(x) for x in coefficients])
    placed = rows.withColumn("_at", clamp(p, lo, hi) / width).withColumn("_b", F.floor("_at").cast("int"))
    placed = placed.withColumn("_f", F.col("_at") - F.col("_b").cast("double"))
    value = (1 - F.col("_f")) * F.element_at(c, F.col("_b") + 1) + F.col("_f") * F.element_at(c, F.col("_b") + 2)
    return placed.select(*rows.columns, value.alias("value"))


def periodic_index(idx: Column, n_columns: int) -> Column:
    return F.pmod(idx, F.lit(n_columns))


def n_basis(lo: float, hi: float, width: float, kind: str, order: int = 4, periodic: bool = False) -> int:
    """Columns of an interaction: bins + 1 (linear), bins + k - 1 (B-spline), bins - 1 (periodic B-spline)."""
    bins = int((hi - lo) / width + 0.5)
    return bins + 1 if kind == "linear" else bins - 1 if periodic else bins + order - 1


def knots(lo: float, hi: float, n_coef: int, order: int) -> np.ndarray:
    """Clamped uniform knots with n_coef - order + 2 breakpoints, the ends moved out by 1e-6."""
    n_break = n_coef - order + 2
    if n_break < 2:
        raise ValueError("a B-spline needs more coefficients than its order")
    inner = np.linspace(lo - AXIS_EPS, hi + AXIS_EPS, n_break)
    return np.concatenate([[inner[0]] * (order - 1), inner, [inner[-1]] * (order - 1)])


def bspline_values(p: np.ndarray, t: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, values): the `order` B-splines that are not 0 at each p, by the Cox-de Boor recursion on all points at once."""
    p = np.clip(np.asarray(p, float), t[0], t[-1])
    n = len(t) - order
    span = np.clip(np.searchsorted(t, p, "right") - 1, order - 1, n - 1)
    vals = np.zeros((len(p), order))
    vals[:, 0] = 1.0
    for d in range(1, order):
        carry = np.zeros(len(p))
        for r in range(d):
            right, left = t[span + r + 1], t[span + r + 1 - d]
            share = vals[:, r] / np.where(right > left, right - left, 1.0)
            vals[:, r] = carry + (right - p) * share
            carry = (p - left) * share
        vals[:, d] = carry
    return span - order + 1, vals


def bspline_slopes(p: np.ndarray, t: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, slopes) of the `order` B-splines that are not 0 at each p."""
    first, lower = bspline_values(p, t[1:-1], order - 1)  # without the outermost knots, so that the last span is the basis's own
    span = first + order - 1
    out = np.zeros((len(span), order))
    for r in range(order):
        i = span - order + 1 + r
        if r > 0:
            d = t[i + order - 1] - t[i]
            out[:, r] += np.where(d > 0, lower[:, r - 1] / np.where(d > 0, d, 1.0), 0.0)
        if r < order - 1:
            d = t[i + order] - t[i + 1]
            out[:, r] -= np.where(d > 0, lower[:, r] / np.where(d > 0, d, 1.0), 0.0)
    return span - order + 1, (order - 1) * out


def pieces(t: np.ndarray, order: int, slope: bool = False) -> np.ndarray:
    """[r, span, power]: the polynomials, in the place within a span (0 to 1), of the `order` B-splines that are not 0 there."""
    n_spans = len(t) - 2 * order + 1
    at = (1 - np.cos(np.pi * (np.arange(order) + 0.5) / order)) / 2  # as many points as a polynomial has coefficients, inside the span
    left, right = t[order - 1 : order - 1 + n_spans], t[order : order + n_spans]
    p = (left[:, None] + (right - left)[:, None] * at).ravel()
    _, vals = (bspline_slopes if slope else bspline_values)(p, t, order)
    vals = vals.reshape(n_spans, order, order)  # span, point, r
    return np.linalg.solve(np.vander(at, increasing=True)[None], vals).transpose(2, 0, 1)


def bspline(lo: float, hi: float, n_coef: int, order: int, slope: bool = False):
    """A function from a Column p to the (idx, val) entries of one interaction's B-spline basis, or of its first derivative.

    Knots are uniform, so a point's span is a division, and its values are polynomials in its place in the span whose
    coefficients are looked up: expressions in generated code. A null p has null entries.
    """
    t = knots(lo, hi, n_coef, order)
    n_spans, width = n_coef - order + 1, float(t[order] - t[order - 1])
    table = [[float(c) for c in piece.ravel()] for piece in pieces(t, order, slope)]

    def entries(p: Column) -> Column:
        x = (F.least(F.greatest(p, F.lit(float(t[0]))), F.lit(float(t[-1]))) - float(t[0])) / width
        span = F.least(F.floor(x), F.lit(n_spans - 1)).cast("int")
        x = x - span
        out = []
        for r, row in enumerate(table):
            coefficients, val = F.lit(row), F.lit(0.0)
            for k in reversed(range(order)):
                val = val * x + F.element_at(coefficients, span * order + (k + 1))
            out.append(F.struct((span + r).alias("idx"), val.alias("val")))
        return F.when(p.isNotNull(), F.array(*out)).cast(ENTRY)

    return entries


def bspline_rows(rows: DataFrame, p: Column, lo: float, hi: float, n_coef: int, order: int, slope: bool = False) -> DataFrame:
    """The rows with idx and val, `order` of them for each that has a p: the entries of `bspline`, as rows.

    A point's span and its place in it are worked out once, before the rows are told apart, and one polynomial is written
    out; exploding the array of `bspline` writes the point's whole expression out at each coefficient.
    """
    t = knots(lo, hi, n_coef, order)
    n_spans, width = n_coef - order + 1, float(t[order] - t[order - 1])
    table = F.lit([float(c) for c in pieces(t, order, slope).ravel()])  # by r, span and power
    placed = rows.withColumn("_x", (F.least(F.greatest(p, F.lit(float(t[0]))), F.lit(float(t[-1]))) - float(t[0])) / width).where(p.isNotNull())
    placed = placed.withColumn("_span", F.least(F.floor("_x"), F.lit(n_spans - 1)).cast("int")).withColumn("_x", F.col("_x") - F.col("_span"))
    wide = placed.select("*", F.explode(F.array(*[F.lit(r) for r in range(order)])).alias("_r"))
    first, val = (F.col("_r") * n_spans + F.col("_span")) * order, F.lit(0.0)
    for k in reversed(range(order)):
        val = val * F.col("_x") + F.element_at(table, first + (k + 1))
    return wide.select(*rows.columns, (F.col("_span") + F.col("_r")).alias("idx"), val.alias("val"))


def bspline_between(n_coef: int, order: int, slope: bool = False):
    """A function (p, lo, hi) to the (idx, val) entries of B-splines whose ranges differ from row to row; they share the number of coefficients.

    A range's knots are those of `knots`; a point's place among them is linear in p, so all ranges share one table of
    polynomials over spans of length 1, and slopes are divided by the range's own span.
    """
    n_spans = n_coef - order + 1
    if n_spans < 1:
        raise ValueError("a B-spline needs as many coefficients as its order at least")
    inner = np.arange(n_spans + 1.0)
    t = np.concatenate([[0.0] * (order - 1), inner, [float(n_spans)] * (order - 1)])
    table = [[float(c) for c in piece.ravel()] for piece in pieces(t, order, slope)]

    def entries(p: Column, lo: Column, hi: Column) -> Column:
        span_width = (hi - lo + 2 * AXIS_EPS) / n_spans
        x = F.least(F.greatest((p - lo + AXIS_EPS) / span_width, F.lit(0.0)), F.lit(float(n_spans)))
        span = F.least(F.floor(x), F.lit(n_spans - 1)).cast("int")
        x = x - span
        out = []
        for r, row in enumerate(table):
            coefficients, val = F.lit(row), F.lit(0.0)
            for k in reversed(range(order)):
                val = val * x + F.element_at(coefficients, span * order + (k + 1))
            out.append(F.struct((span + r).alias("idx"), (val / span_width if slope else val).alias("val")))
        return F.when(p.isNotNull(), F.array(*out)).cast(ENTRY)

    return entries


def hat_slope(p: Column, lo: Column | float, hi: Column | float, width: Column | float) -> Column:
    """Two (idx, val) entries of the linear basis's slope: -1 / width and 1 / width on the knots around p."""
    b = F.floor(clamp(p, lo, hi) / width).cast("int")
    up = 1.0 / (F.lit(width) if not isinstance(width, Column) else width)
    return F.array(F.struct(b.alias("idx"), (-up).alias("val")), F.struct((b + 1).alias("idx"), up.alias("val")))


def evaluate(p: np.ndarray, coefficients: np.ndarray, lo: float, hi: float, kind: str, order: int = 4, width: float | None = None, slope: bool = False) -> np.ndarray:
    """A spline with given coefficients at points p."""
    c = np.asarray(coefficients, float)
    if kind == "linear":
        at = np.clip((np.asarray(p, float) - lo) / width, 0, len(c) - 1 - 1e-12)
        b = at.astype(int)
        return (c[b + 1] - c[b]) / width if slope else c[b] * (1 - (at - b)) + c[b + 1] * (at - b)
    first, vals = (bspline_slopes if slope else bspline_values)(p, knots(lo, hi, len(c), order), order)
    return (vals * c[first[:, None] + np.arange(order)]).sum(1)
