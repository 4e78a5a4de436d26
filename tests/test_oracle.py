"""Every registered query against its DuckDB oracle on the smoke tables (sf0.001)."""

import hashlib
import math

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return str(v).lower()
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_oracle_or_is_rows_only():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMOKE)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _digest(df.columns, srows) == _digest(ocols, orows)


SHARES = {"accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "mean_cv_f1", "live_ml_non_compliance_probability"}
#: Queries whose result has a row for each row of a table, and that table.
PER_ROW = {f"op{n}_": "documents" for n in (1, 2, 4, 5, 7, 8, 9, 10, 12)} | {"op3_": "pages", "ml_score_live_model": None}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_query(spark, duck, name):
    """Rows, shares between 0 and 1, no column that is always null, and a row a document where that is the rule."""
    df = QUERIES[name](spark, SMOKE)
    rows = df.collect()
    assert rows
    for c in df.columns:
        values = [r[c] for r in rows]
        if c in SHARES:
            assert all(v is None or 0 <= v <= 1 for v in values)
        if c == "live_ml_fallback_reason":
            continue
        assert any(v is not None for v in values), c
    table = next((t for p, t in PER_ROW.items() if name.startswith(p) and t), None)
    if table:
        assert len(rows) == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name == "ml_shuffle_check":
        assert abs(rows[0]["accuracy"] - 0.5) < 0.25
    if name == "ml_report":
        assert {r["verdict"] for r in rows} <= {"PASS", "FAIL"} and all((r["verdict"] == "PASS") == (r["fail_reasons"] == "") for r in rows)
    if name == "ml_tune":
        assert {r["model"] for r in rows} == {"LogisticRegression", "RandomForest", "GBT"} and len(rows) == 3 + 18 + 6
    if name == "xp_perm_imp":
        assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert hashlib.md5(",".join(df.columns).encode()).hexdigest()
