from __future__ import annotations

import pytest
from conftest import SF_DIR, same_rows

from docwarden.plans import catalogue, sheets  # noqa: F401  (both register their queries)

#: the small tables have no such rows
MAY_BE_EMPTY = {"scan_documents"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    rows = same_rows(catalogue.QUERIES[name](spark, SF_DIR), duck, catalogue.ORACLE_SQL[name])
    assert rows or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF_DIR).count() or name in MAY_BE_EMPTY


def test_scan_is_one_pass(spark):
    plan = catalogue.scan_cards(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") <= 1


def test_array_suppression_equals_anti_join(spark):
    from docwarden.plans.scan import local_candidates, suppress_rows

    rows = catalogue.unsuppressed(spark, SF_DIR).cache()
    columns = ("path", "rule_id", "line", "score", "description")
    by_join = sorted(tuple(r[c] for c in columns) for r in suppress_rows(rows).collect())
    by_array = sorted(tuple(r[c] for c in columns) for r in local_candidates(catalogue.cards(spark, SF_DIR), catalogue._rules(), catalogue.Config()).collect())
    assert by_array == by_join
    assert len(by_array) < rows.count()
    rows.unpersist()
