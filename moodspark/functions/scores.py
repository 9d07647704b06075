"""Score-vector expressions over ``array<double>`` columns (MOD7, MOD8, SCO3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(scores) -> Column:
    """Index of the first maximum (ties -> lowest class index)."""
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def margin(scores) -> Column:
    """Top-1 minus top-2 score."""
    s = F.sort_array(_col(scores), asc=False)
    return s.getItem(0) - s.getItem(1)


def as_two_columns(scores) -> Column:
    """A one-element score ``[v]`` becomes ``[-v, v]``; longer arrays unchanged."""
    s = _col(scores)
    return F.when(F.size(s) == 1, F.array(-s.getItem(0), s.getItem(0))).otherwise(s)


def weighted_sum(score_cols: list, weights: list[float] | None = None) -> Column:
    """Normalised weighted element-wise sum of score arrays (equal weights by default)."""
    n = len(score_cols)
    w = [1.0] * n if not weights else [float(x) for x in weights]
    total = sum(w)
    w = [x / total for x in w]
    def add(wi):
        return lambda a, b: a + b * F.lit(wi)

    acc = F.transform(_col(score_cols[0]), lambda v: v * F.lit(w[0]))
    for c, wi in zip(score_cols[1:], w[1:]):
        acc = F.zip_with(acc, _col(c), add(wi))
    return acc


def softmax_at(scores, index) -> Column:
    """Soft-max of a score vector evaluated at ``index`` (0-based)."""
    s = _col(scores)
    mx = F.array_max(s)
    denom = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.exp(v - mx))
    return F.exp(F.element_at(s, _col(index) + 1) - mx) / denom


def confidence(scores, index, probability=None) -> Column:
    """SCO3: probability of the predicted class when present; else soft-max of
    the decision scores; a single score uses ``1/(1+exp(-|v|))``."""
    s = _col(scores)
    dec = (F.when(F.size(s) == 1, 1.0 / (1.0 + F.exp(-F.abs(s.getItem(0)))))
           .otherwise(softmax_at(s, index)))
    if probability is None:
        return dec
    p = _col(probability)
    return F.coalesce(F.element_at(p, _col(index) + 1), dec)


def hex_unit(hexstr, start: int) -> Column:
    """Four hex digits of an md5 string scaled to [-1, 1] (deterministic fixtures)."""
    v = F.conv(F.substring(_col(hexstr), start, 4), 16, 10).cast("int")
    return v / F.lit(65535.0) * 2 - 1


#: Splits a double into two halves of 26 bits (Veltkamp's constant, 2**27 + 1).
_SPLITTER = 134217729.0


def round_exact(c, places: int) -> Column:
    """PRJ7: round the exact binary value, ties to even (2.675 is below its
    decimal form and gives 2.67), as the reference's language does.

    ``c * 10**places`` is formed with its rounding error (a product without
    error from split factors), so a tie is told from what merely looks like one.
    """
    x = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** places)
    p = x * F.lit(scale)
    t = x * F.lit(_SPLITTER)
    hi = t - (t - x)
    lo = x - hi
    ts = scale * _SPLITTER
    s_hi = ts - (ts - scale)
    s_lo = scale - s_hi
    error = ((hi * F.lit(s_hi) - p) + hi * F.lit(s_lo) + lo * F.lit(s_hi)) + lo * F.lit(s_lo)
    down = F.floor(p).cast("double")
    part = p - down
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(down, F.lit(2.0)) == 1.0))))
    # a product that was rounded up to a whole number belongs below it only by
    # its error, which can't change the nearest whole number
    return F.when(up, down + 1.0).otherwise(down) / F.lit(scale)
