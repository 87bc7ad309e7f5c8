"""All queries of the core, and their SQL."""

from __future__ import annotations

from pitchgrid.plans import core_queries, dataset_queries, extra_queries, fold_sql, match_queries, quality_sql, source_queries

MODULES = [core_queries, match_queries, dataset_queries, extra_queries, fold_sql, quality_sql, source_queries]
FLAGSHIP = match_queries.QUERIES["AGG05_possession_by_team"]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in getattr(m, "QUERIES", {}).items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
