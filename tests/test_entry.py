"""The driver's contract."""

import pytest

import __spark_entry__ as entry

CORE = ["a8_stratified_calibration", "w1_gold_precedence", "t2_trace_states", "j8_paired_overlap", "i4_agent_slots", "p3_found", "p4_found", "c10_relations", "r1_incremental_scoring"]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "stmt_type", "n_stmts", "mae", "rmse", "bias"] and df.count() > 0


@pytest.mark.parametrize("name", CORE)
def test_queries_run(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p3_found", ["source_table", "parent_key", "child_path", "child_value"]), ("p4_found", ["ref_table", "ref_field", "period", "ref_key"])],
)
def test_columns_of_found_queries(spark, folder, name, columns):
    assert entry.queries()[name](spark, folder).columns == columns


def test_wide_scans_are_not_read(spark, folder):
    plan = entry.queries()["p4_found"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "raw_json" not in plan and "db_refs_json" not in plan
