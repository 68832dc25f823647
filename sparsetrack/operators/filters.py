"""Threshold search, removal, filling, shifting, condensing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import narrowed, predicate
from ..plans.intervals import clip, complement, intersect, merge, subtract


def find_threshold(signal: DataFrame, op: str, x: float, inverse: bool = False, sections: DataFrame | None = None) -> DataFrame:
    """Maximal stretches of bases that satisfy the comparison; a gap, or a section's end, ends one."""
    keys = ("chrom",) if sections is None else ("section_id", "chrom")
    rows = signal if sections is None else clip(signal, sections)
    return merge(rows.where(predicate(op, F.col("value"), x, inverse)), keys).select("chrom", "start", "end")


def remove_threshold(signal: DataFrame, op: str, x: float, inverse: bool = False) -> DataFrame:
    """The signal without the bases that satisfy the comparison; x is rounded to 32 bits, as stored values are."""
    return signal.where(~predicate(op, F.col("value"), narrowed(x), inverse))


def remove_mask(signal: DataFrame, mask: DataFrame, inverse: bool = False, strict_compat: bool = False) -> DataFrame:
    """The signal outside the mask, or inside it (``inverse``).

    ``strict_compat``: chromosomes that the mask doesn't name go, too.
    """
    out = intersect(signal, mask) if inverse else subtract(signal, mask)
    return out.join(mask.select("chrom").distinct(), "chrom", "left_semi") if strict_compat else out


def fill(signal: DataFrame, sections: DataFrame, value: float) -> DataFrame:
    """The signal within sections, with ``value`` wherever it has none."""
    return clip(signal, sections).select("chrom", "start", "end", "value").union(complement(signal, sections).select("chrom", "start", "end", F.lit(float(value))))


def shift(signal: DataFrame, sections: DataFrame, n: int) -> DataFrame:
    """Data moved ``n`` bases to higher coordinates within each section; what leaves it is gone."""
    if n == 0:
        raise ValueError("a shift of 0 does nothing")
    inside = clip(signal, sections).join(sections.select("section_id", F.col("start").alias("s"), F.col("end").alias("e")), "section_id")
    moved = inside.select("chrom", F.greatest(F.col("start") + n, "s").alias("start"), F.least(F.col("end") + n, "e").alias("end"), "value")
    return moved.where("end > start")
