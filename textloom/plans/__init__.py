"""The registry of this library's queries and of the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = tuple(
    f"textloom.{m}"
    for m in (
        "operators.signals", "operators.condense", "operators.records", "operators.jsonsets", "operators.relevance", "operators.search_index", "operators.accounting", "operators.conversation", "operators.bodies",
        "operators.diffs", "operators.code", "operators.shaping", "streaming.sse", "streaming.ledger", "streaming.contents", "streaming.rollups", "streaming.usage", "plans.requests", "plans.reports", "plans.table_functions",
    )
)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(m).ORACLES
    return out
