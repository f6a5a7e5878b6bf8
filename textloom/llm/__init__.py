"""Operators for building training corpora. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

_MODULES = ("url_filters", "packing", "binary_output", "language_id", "neighbours", "decontamination", "pii", "jaccard_join", "suffix_dedup", "lm_scoring", "exact_dedup", "resampling", "vector_codes")


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= importlib.import_module(f"{__name__}.{m}").QUERIES
    import corpus_pipeline

    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out |= importlib.import_module(f"{__name__}.{m}").ORACLES
    import corpus_pipeline

    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
