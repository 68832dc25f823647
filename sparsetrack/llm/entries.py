"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .op1_toxicity import op1_toxicity
from .op2_sstable import op2_sstable
from .op3_suffix_dedup import op3_suffix_dedup
from .op4_kneser_ney import op4_kneser_ney
from .op5_collision_search import op5_collision_search
from .op6_minmax_dedup import op6_minmax_dedup
from .op7_substring_dedup import op7_substring_dedup
from .op8_decontaminate import op8_decontaminate
from .op9_html_extraction import op9_html_extraction
from .op10_packing import op10_packing
from .op11_whitening import op11_whitening
from .op12_weighted_sampling import op12_weighted_sampling
from .op13_ranked_search import op13_ranked_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_sstable, op3_suffix_dedup, op4_kneser_ney, op5_collision_search, op6_minmax_dedup, op7_substring_dedup, op8_decontaminate, op9_html_extraction, op10_packing, op11_whitening, op12_weighted_sampling, op13_ranked_search)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Operators 3, 6, 7, 8 and 13.

    The others have no SQL form (trained models, tokenizers, a parser, an approximate search, eigenvectors, hashed draws); tests hold them against
    brute force, a round trip or held-out accuracy.
    """
    return oracles.oracle_sql()
