"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subsidia.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from subsidia.llm.jaccard_join import op9_ngram_jaccard
from subsidia.llm.language_id import op5_language_id
from subsidia.llm.lexical_search import OP11_SQL, op11_lexical_search
from subsidia.llm.license_scans import op4_license_scans
from subsidia.llm.merkle import OP12_SQL, op12_merkle_manifest
from subsidia.llm.mixing import OP3_SQL, op3_source_mix
from subsidia.llm.packing import op10_packing
from subsidia.llm.secret_scans import op6_secret_scans
from subsidia.llm.suffix_dedup import op13_suffix_dedup
from subsidia.llm.token_counts import op2_token_counts
from subsidia.llm.topk_search import OP7_SQL, op7_topk_search
from subsidia.llm.url_filters import OP1_SQL, op1_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_source_mix": op3_source_mix,
    "op4_license_scans": op4_license_scans,
    "op5_language_id": op5_language_id,
    "op6_secret_scans": op6_secret_scans,
    "op7_topk_search": op7_topk_search,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_packing": op10_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES: dict[str, str] = {"op1_url_filters": OP1_SQL, "op3_source_mix": OP3_SQL, "op7_topk_search": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_lexical_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
