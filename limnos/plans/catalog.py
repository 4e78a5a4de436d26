"""Query catalog: every registered query and its oracle SQL."""

from __future__ import annotations

import importlib

_QUERY_MODULES = ["queries_labels", "queries_cleaning", "queries_monitoring", "queries_profile", "queries_live", "queries_extra", "queries_history", "queries_standardize", "queries_io", "queries_ml"]
_ORACLE_MODULES = ["labels_sql", "cleaning_sql", "monitoring_sql", "profile_sql", "live_sql", "extra_sql", "serving_sql", "history_sql", "standardize_sql", "io_sql", "ml_sql"]


def all_queries() -> dict:
    out = {}
    for m in _QUERY_MODULES:
        out.update(importlib.import_module(f"limnos.plans.{m}").Q)
    return out


def _count_if_as_bigint(sql: str) -> str:
    """Rewrite DuckDB `count_if(c)` (HUGEINT) as `count(*) FILTER (WHERE c)` (BIGINT, like Spark)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _count_if_as_bigint(sql[j + len(key):k - 1])
        out.append(f"(count(*) FILTER (WHERE {inner}))")
        i = k


def all_oracle_sql() -> dict:
    out = {}
    for m in _ORACLE_MODULES:
        out.update(importlib.import_module(f"limnos.oracle.{m}").SQL)
    return {k: _count_if_as_bigint(v) for k, v in out.items()}
