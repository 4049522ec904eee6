"""Every query of the library that SQL states gives DuckDB's rows; the others run."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

from spanloom.plans import library

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = library.queries(), library.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return str(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value) if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    expected = duck.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    rows = [[plain(r[c]) for c in sorted(columns)] for r in found.collect()]
    wanted = [[plain(r[columns.index(c)]) for c in sorted(columns)] for r in expected.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_other_queries_give_the_same_rows_again(spark, name):
    """Rules without SQL are held against hand-made rows in test_operators; here they must find something, twice the same."""
    found, again = (sorted(map(repr, QUERIES[name](spark, DATA).collect())) for _ in range(2))
    assert found and found == again


def test_plans_have_no_cartesian_product(spark):
    for name in ("gf_tool_latency_top", "session_list", "cost_by_agent", "scorecard"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_alerts_compute_spans_once(spark):
    """Three parts of the statement read spans; the tables of line items are joined and dealt for one of them alone."""
    plan = QUERIES["evaluate_alerts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "LogicalRDD" in plan
