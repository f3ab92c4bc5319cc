"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm._sql import OP4_SQL, OP7_SQL, OP8_SQL
from larkspur.llm.decontaminate import op4_decontaminate
from larkspur.llm.divergence import OP13_SQL, op13_source_divergence
from larkspur.llm.fingerprints import OP11_SQL, op11_fingerprints
from larkspur.llm.impact_index import OP12_SQL, op12_ranked_search
from larkspur.llm.licenses import OP2_SQL, op2_license_scan
from larkspur.llm.neighbors import OP10_SQL, op10_nearest_neighbors
from larkspur.llm.ngram_join import op7_ngram_jaccard
from larkspur.llm.packing import op1_harmonic_packing
from larkspur.llm.pii import op9_pii_surrogates
from larkspur.llm.quality import op6_quality_cotraining
from larkspur.llm.substrings import op8_substring_dedup
from larkspur.llm.toxicity import op3_toxicity
from larkspur.llm.urls import op5_url_filter

_ALL = [
    op1_harmonic_packing,
    op2_license_scan,
    op3_toxicity,
    op4_decontaminate,
    op5_url_filter,
    op6_quality_cotraining,
    op7_ngram_jaccard,
    op8_substring_dedup,
    op9_pii_surrogates,
    op10_nearest_neighbors,
    op11_fingerprints,
    op12_ranked_search,
    op13_source_divergence,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": OP2_SQL,
        "op4_decontaminate": OP4_SQL,
        "op7_ngram_jaccard": OP7_SQL,
        "op8_substring_dedup": OP8_SQL,
        "op10_nearest_neighbors": OP10_SQL,
        "op11_fingerprints": OP11_SQL,
        "op12_ranked_search": OP12_SQL,
        "op13_source_divergence": OP13_SQL,
    }
