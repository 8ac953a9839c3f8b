"""Physical plans: what must hold at any size."""

import re

import pytest

from __spark_entry__ import queries
from fixtures.cases import QUERIES as OWN
from plans import plan_text

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {key: query for key, query in queries().items() if key in OWN}
LOG_KEYS = [
    "w_daily_query_stats", "w_database_activity", "w_resource_signals", "w_daily_duration", "w_top_errors", "w_total_credits",
    "access_events", "w_daily_cost", "w_task_runs", "w_pipe_ingest", "w_data_transfer", "w_logins_by_client_type", "priced_usage",
    "l_daily_query_volume", "l_compute_exec_stats", "l_daily_active_users", "l_top_read_tables", "l_job_totals", "l_ai_gateway",
]


@pytest.fixture
def no_broadcast(spark):
    """As for dimensions beyond the broadcast threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("key", list(QUERIES))
def test_no_pairwise_join_and_no_python(spark, no_broadcast, key):
    text = plan_text(QUERIES[key](spark, SF_DIR))
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in text


@pytest.mark.parametrize("key", LOG_KEYS)
def test_the_window_reaches_the_log_scan(spark, key):
    text = plan_text(QUERIES[key](spark, SF_DIR))
    pushed = " ".join(re.findall(r"PushedFilters: \[[^\n]*", text))
    assert re.search(r"GreaterThanOrEqual\((ts|o_orderdate|l_shipdate),", pushed)
    assert re.search(r"LessThan(OrEqual)?\((ts|o_orderdate|l_shipdate),", pushed)


@pytest.mark.parametrize("key,columns", [
    ("w_daily_query_stats", {"ts", "user_id", "props"}),
    ("w_total_credits", {"ts", "value"}),
    ("l_job_totals", {"o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"}),
])
def test_only_used_columns_are_read(spark, key, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_text(QUERIES[key](spark, SF_DIR)))
    assert {c.split(":")[0] for s in read for c in s.split(",")} == columns


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", [
    "top_n_with_other", "w_database_activity_trend", "w_database_storage_trend", "monthly_bill_pivot", "l_monthly_bill_pivot",
])
def test_ranking_shares_the_shuffle_of_its_input(spark, key):
    """The top keys and the folded rows come from one pass over the source."""
    final = _final_plan(QUERIES[key](spark, SF_DIR))
    assert "ReusedExchange" in final
    assert len(re.findall("FileScan", final)) == 1


@pytest.mark.parametrize("key", ["w_top_errors", "l_top_errors"])
def test_errors_are_counted_and_sampled_from_one_scan(spark, key):
    final = _final_plan(QUERIES[key](spark, SF_DIR))
    assert "ReusedExchange" in final and len(re.findall("FileScan", final)) == 1


def _sorted_scans(text: str) -> int:
    """Sort aggregates fed by a scan without a shuffle in between, which would sort that table."""
    lines = [re.sub(r"^[\s:|+-]*(\*\(\d+\) )?", lambda m: " " * len(m[0]), line) for line in text.splitlines()]
    found = 0
    for i, line in enumerate(lines):
        if not line.lstrip().startswith("SortAggregate"):
            continue
        depth = len(line) - len(line.lstrip())
        for below in lines[i + 1 :]:
            if len(below) - len(below.lstrip()) <= depth or below.lstrip().startswith("Exchange"):
                break
            if below.lstrip().startswith("FileScan"):
                found += 1
                break
    return found


def test_logs_are_folded_by_hash_aggregates(spark):
    """No log is sorted; of errors, only the messages of the reasons that lead are."""
    logs = [*LOG_KEYS, "w_exec_stats", "w_service_account_stats", "w_table_rw_by_user", "l_service_account_stats", "w_mv_refresh"]
    sorted_scans = {k: _sorted_scans(plan_text(QUERIES[k](spark, SF_DIR))) for k in logs}
    # l_service_account_stats and l_compute_exec_stats sort their small name dimensions
    assert {k for k, n in sorted_scans.items() if n} == {"l_service_account_stats", "l_compute_exec_stats"}


def test_comparisons_read_stored_summaries(spark):
    """Two one-row files, no log."""
    text = plan_text(QUERIES["comparison_table"](spark, SF_DIR))
    assert text.count("FileScan json") == 2 and "Scan parquet" not in text


def test_cost_reads_only_its_keys(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_text(QUERIES["l_daily_cost"](spark, SF_DIR)))
    assert not any("l_suppkey" in s for s in read), "the run_as behind it is not needed"


def test_a_year_of_days_does_not_sort_the_log(spark):
    rows = spark.range(0, 40_000, 1, 4).selectExpr(
        "TIMESTAMP'2023-01-01' + make_dt_interval(CAST(id * 7919 % 365 AS INT)) AS start_time", "id % 1000 AS execution_time"
    )
    from meterlens.functions import Lookback
    from meterlens.operators.activity import w_daily_duration

    df = w_daily_duration(rows, Lookback("2024-01-01", 365))
    assert df.count() == 365
    spilled = re.findall(r"number of sort fallback tasks[^\n]*", df._jdf.queryExecution().executedPlan().toString())
    assert spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold") == "4096" and not spilled
