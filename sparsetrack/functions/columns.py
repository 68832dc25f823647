"""Column builders: predicates, re-centred windows, quantile names."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comparison names.
COMPARISONS = {"less": operator.lt, "less-equal": operator.le, "more": operator.gt, "more-equal": operator.ge, "equal": operator.eq, "not-equal": operator.ne, "not": operator.ne}


def predicate(op: str, value: Column, x: float | Column, inverse: bool = False) -> Column:
    """``value op x``; NULL values satisfy nothing, inverse or not."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison: {op}")
    p = COMPARISONS[op](value, x if isinstance(x, Column) else F.lit(float(x)))
    return ~p if inverse else p


def narrowed(x: float) -> Column:
    """A threshold as signals at rest have it: rounded to 32 bits."""
    return F.lit(float(x)).cast("float").cast("double")


def recentred(start: Column, end: Column, strand: Column, left: int, right: int, anchor: str = "centre", firstbase: bool = False) -> tuple[Column, Column]:
    """Start and end of the window around a region's anchor (centre, starts or ends), by strand."""
    minus = F.coalesce(strand, F.lit("+")) == "-"
    size = end - start
    half = F.floor(size / 2).cast("long")
    extra = F.lit(1 if firstbase else 0)
    if anchor == "centre":
        plus_at, minus_at = start + half, start + half + size % 2
        plus = plus_at - left, plus_at + right + extra
        neg = minus_at - right - extra, minus_at + left
    elif anchor == "starts":
        plus = start - left, start + right + extra
        neg = end - right - extra, end + left
    elif anchor == "ends":
        plus = end - left - extra, end + right
        neg = start - right, start + left + extra
    else:
        raise ValueError(f"unknown anchor: {anchor}")
    return F.when(minus, neg[0]).otherwise(plus[0]), F.when(minus, neg[1]).otherwise(plus[1])


def offset_in(pos: Column, start: Column, end: Column, strand: Column) -> Column:
    """Place of a base in its window, counted from the other end on the minus strand."""
    return F.when(F.coalesce(strand, F.lit("+")) == "-", end - 1 - pos).otherwise(pos - start)


def position_label(offset: Column, left: int, firstbase: bool = False) -> Column:
    """Offsets as positions around the anchor: -left .. -1, 1 .. right; with ``firstbase`` 0 is the base itself."""
    p = offset - left
    return p if firstbase else F.when(p >= 0, p + 1).otherwise(p)
