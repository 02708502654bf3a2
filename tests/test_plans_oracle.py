"""Plan shape (no Python evaluation, anti-join, map-side top-n, one shuffle
of class rows) and Spark vs DuckDB oracle on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_core_plans(spark):
    for name in ["resume_row", "route_done", "running_boundaries", "union_log_parts"]:
        p = _plan(E.queries()[name](spark, SF_SMALL))
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_anti_join_and_group_limit(spark):
    assert "LeftAnti" in _plan(E.queries()["new_raw_rows"](spark, SF_SMALL))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(E.queries()["latest_n_per_key"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


ORACLE_SAMPLE = ["detail_row", "running_boundaries", "message_prefilter", "system_match", "record_layout", "route_fail",
                 "route_garbage", "route_last_ipl", "route_rules", "datasets_with_ipl", "jes_level", "first_last_n", "page", "resume_row", "route_done",
                 "union_log_parts", "first_last_boundaries", "format_hms_floor", "is_datetime",
                 "report_format", "inventory_insert_if_absent"]


def _norm(v):
    return "\x00NULL" if v is None else str(v)


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ["events", "supplier"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want


def test_no_row_is_vacuous(spark):
    """Each of these operators drops some rows of the fixture and keeps others."""
    from cyclewise.operators.boundaries import dataset_spans
    from cyclewise.operators.parse import message_prefilter, parse_lines
    from cyclewise.plans.catalog import detail, lines
    n = lines(spark, SF_SMALL).count()
    kept = message_prefilter(lines(spark, SF_SMALL)).count()
    assert 0 < kept < n and parse_lines(lines(spark, SF_SMALL)).count() < kept
    assert {r[0] for r in detail(spark, SF_SMALL).select("layout").distinct().collect()} == set(range(1, 9))
    assert {r[0] for r in dataset_spans(detail(spark, SF_SMALL)).select("has_ipl").distinct().collect()} == {True, False}
    assert {r[0] for r in E.queries()["route_counts"](spark, SF_SMALL).collect()} == {"done", "fail", "garbage", "last_ipl"}
    one = lines(spark, SF_SMALL)
    assert one.select("log_dataset", "line_no").distinct().count() == n
