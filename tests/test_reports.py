"""Whole reports: they agree with the single measures, and degrade as documented."""

import pytest

from fixtures.cases import ORACLES
from fixtures.cases.registry import EV, LI, OR
from fixtures.views import ACCOUNT, DOMAIN, EMPLOYEES, VIEWS
from check import compare, duck_rows, spark_rows
from meterlens.plans.comparison import comparison_report
from meterlens.plans.lakehouse import lakehouse_report
from meterlens.plans.output import read_report, summary_path, write_report
from meterlens.plans.settings import ReportSettings, stage_to
from meterlens.plans.warehouse import warehouse_report
from meterlens.session import scratch_dir
from meterlens.sources import read_summary_json

EVENTS, ORDERS = [
    {name for name, v in VIEWS.items() if v.source == source} for source in ("events", "orders")
]


def settings(**changes):
    windows = {name: EV if name in EVENTS else OR if name in ORDERS else LI for name in VIEWS}
    given = {"domain": DOMAIN, "employee_label": EMPLOYEES, "account": ACCOUNT, "windows": windows, "generated_at": "now"}
    return ReportSettings(EV, **(given | changes))


def inputs(tables, side, *without):
    return {name: tables[name] for name in VIEWS if name.startswith(side) and name not in without}


@pytest.fixture(scope="module")
def warehouse(spark, tables):
    given = inputs(tables, "w_") | {"network_policies": tables["network_policies"]}
    return warehouse_report(given, settings(), stage_to(scratch_dir(spark, "report-w")))


@pytest.fixture(scope="module")
def lakehouse(spark, tables):
    return lakehouse_report(inputs(tables, "l_", "l_table_log"), settings(), stage_to(scratch_dir(spark, "report-l")))


WAREHOUSE_KEYS = {
    "daily_query_stats": "w_daily_query_stats", "top_users": "w_top_users", "database_activity_trend": "w_database_activity_trend",
    "resource_signals": "w_resource_signals", "failed_waste": "w_failed_waste", "daily_volume_by_type": "w_daily_volume_by_type",
    "service_accounts": "service_account_summary", "total_credits": "w_total_credits", "credits_by_warehouse": "w_credits_by_warehouse",
    "dead_tables": "dead_tables", "table_access_detail": "w_table_access_detail", "service_account_tables": "w_user_table_counts",
    "cumulative_cost": "cumulative_cost", "cost_by_warehouse": "w_cost_by_warehouse", "cost_by_user": "w_cost_by_user",
    "wasted_compute_cost": "wasted_compute_cost", "monthly_bill_grid": "monthly_bill_pivot", "task_runs": "w_task_runs",
    "logins_by_channel": "w_logins_by_channel", "overview": "overview", "login_total": "w_login_total",
    "lifecycle_policy_count": "w_lifecycle_policy_count",
}
LAKEHOUSE_KEYS = {
    "query_totals": "l_overview", "daily_query_volume": "l_daily_query_volume", "daily_volume_by_type": "l_daily_volume_by_type",
    "compute_exec_stats": "l_compute_exec_stats", "daily_cost": "l_daily_cost", "cost_by_sku": "l_cost_by_sku",
    "cost_by_user": "l_cost_by_user", "monthly_bill_grid": "l_monthly_bill_pivot", "top_actors": "l_top_actors",
    "top_read_tables": "l_top_read_tables", "service_account_tables": "l_service_account_tables", "job_runs": "l_job_runs",
    "job_totals": "l_job_totals", "task_types": "l_task_types", "largest_tables": "l_largest_tables", "mlflow": "l_mlflow_summary",
    "service_accounts": "l_service_account_stats", "actions_by_service": "l_actions_by_service", "daily_job_runs": "l_daily_job_runs",
    "daily_active_users": "l_daily_active_users", "ai_gateway_totals": "l_ai_gateway_totals",
    "serving_endpoint_total": "l_serving_endpoint_total",
}


@pytest.mark.parametrize("name", WAREHOUSE_KEYS)
def test_warehouse_report_agrees(warehouse, duck, name):
    assert compare(spark_rows(warehouse[name]), duck_rows(duck, ORACLES[WAREHOUSE_KEYS[name]])) is None


@pytest.mark.parametrize("name", LAKEHOUSE_KEYS)
def test_lakehouse_report_agrees(lakehouse, duck, name):
    assert compare(spark_rows(lakehouse[name]), duck_rows(duck, ORACLES[LAKEHOUSE_KEYS[name]])) is None


def test_every_measure_of_a_full_report_has_rows(warehouse, lakehouse):
    for report in (warehouse, lakehouse):
        for name, df in report.items():
            if name in ("real_billed_total", "discount"):
                assert df is None, "no export was given"
            elif name == "login_shares":
                assert df is None, "no login was named"
            else:
                assert df is not None and df.limit(1).count() == 1, name


def test_summaries(warehouse, lakehouse):
    w = warehouse["platform_summary"].collect()[0]
    assert (w.platform, w.lookback_days, w.cost_is_estimate, w.real_billed_discount_ratio) == ("warehouse", EV.days, False, None)
    l = lakehouse["platform_summary"].collect()[0]
    assert (l.cost_is_estimate, l.compute_cost_is_estimate, l.real_billed_discount_ratio) == (True, True, None)
    assert l.total_cost_usd == lakehouse["overview"].collect()[0].total_cost_usd


def test_without_access_history(tables):
    report = warehouse_report(inputs(tables, "w_", "w_access_history"), settings())
    assert report["dead_tables"] is None and report["table_access_detail"] is None
    accounts = report["service_accounts"].collect()
    assert accounts and all((r.read_count, r.write_count) == (0, 0) for r in accounts)
    assert report["logins_by_channel"] is None, "no policies were given"


def test_without_user_types(tables):
    given = inputs(tables, "w_") | {"w_users": tables["w_users"].drop("user_type")}
    report = warehouse_report(given, settings())
    assert report["daily_active_by_type"] is None and report["service_accounts"] is None
    summary = report["platform_summary"].collect()[0]
    assert (summary.active_users_human, summary.active_users_service) == (0.0, 0.0)


def test_cost_falls_back_to_prices_and_then_to_none(tables):
    bare = inputs(tables, "w_", "w_billing", "w_objects", "w_task_history", "w_attribution")
    estimated = warehouse_report(bare, settings(credit_price=2.0))
    assert estimated["cost_basis"].collect()[0].is_estimate
    assert estimated["monthly_bill"] is None and estimated["cost_by_user"] is None
    assert [r.usage_type for r in estimated["cost_by_type"].collect()] == ["compute (estimated)"]
    assert estimated["overview"].collect()[0].headline == "estimated cost"
    none = warehouse_report(bare, settings())
    assert none["cost_basis"] is None and none["overview"].collect()[0].headline == "credits"
    summary = none["platform_summary"].collect()[0]
    assert (summary.total_cost_usd, summary.cost_is_estimate, summary.total_tables, summary.automation_run_count) == (0.0, True, 0, 0)


def test_table_sizes_are_those_of_the_log_where_there_is_one(tables, duck):
    report = lakehouse_report(inputs(tables, "l_", "l_file_manifest"), settings())
    sized = spark_rows(report["largest_tables"])
    whole = duck_rows(duck, ORACLES["table_sizes_from_log"])
    order = [sized[0].index(c) for c in whole[0]]
    assert sized[1] and {tuple(r[k] for k in order) for r in sized[1]} <= {*map(tuple, whole[1])}


def test_lakehouse_without_optional_sources(tables):
    report = lakehouse_report(
        inputs(tables, "l_", "l_file_manifest", "l_table_log", "l_runs", "l_gateway_usage", "l_job_payloads"), settings()
    )
    for name in ("storage", "mlflow", "ai_gateway", "ai_gateway_totals", "task_types"):
        assert report[name] is None
    assert report["platform_summary"].collect()[0].total_storage_gb == 0
    detail = report["table_access_detail"].collect()
    assert detail and all(r.size_bytes is None for r in detail)
    assert report["quality_monitoring"].collect()[0].check_runs > 0


def test_a_written_report_is_read_back_without_its_sources(spark, warehouse):
    out = scratch_dir(spark, "report-out")
    some = {name: warehouse[name] for name in ("overview", "top_users", "platform_summary")} | {"discount": None}
    assert write_report(some, out) == ["overview", "top_users", "platform_summary"]
    back = read_report(spark, out, some)
    assert back["discount"] is None
    for name in ("overview", "top_users", "platform_summary"):
        assert compare(spark_rows(back[name]), spark_rows(warehouse[name])) is None
    assert compare(spark_rows(read_summary_json(spark, summary_path(out))), spark_rows(warehouse["platform_summary"])) is None


def test_comparison_of_two_reports(warehouse, lakehouse):
    both = comparison_report(warehouse["platform_summary"], lakehouse["platform_summary"])
    assert {name: df.count() for name, df in both.items()} == {
        "lookback_mismatch": 1, "migration_projection": 1, "projection_delta": 1, "comparison_table": 18,
    }
    assert both["migration_projection"].collect()[0].projected_usd > 0


def test_shares_and_folds_of_a_report(spark, tables, warehouse, lakehouse):
    given = inputs(tables, "w_", "w_access_history") | {"network_policies": tables["network_policies"]}
    report = warehouse_report(given, settings(watched_login=("Unmatched", "UI")))
    row = report["login_shares"].collect()[0]
    assert 0 <= row.channel_percent <= 100 and 0 <= row.client_type_percent <= 100
    pairs = [(warehouse, "cost_by_type", "usd"), (warehouse, "logins_by_channel", "login_count"), (lakehouse, "actions_by_service", "action_count")]
    for whole, name, value in pairs:
        top = whole[f"{name}_top"].collect()
        assert len(top) <= 6 and sum(r[value] for r in top) == pytest.approx(sum(r[value] for r in whole[name].collect()))
    series = lakehouse["daily_active_series"].groupBy("day").count().collect()
    assert len({r["count"] for r in series}) == 1


def test_a_report_is_rebuilt_from_its_stage(spark, tables):
    stage_dir = scratch_dir(spark, "report-resume")
    full = lakehouse_report(inputs(tables, "l_"), settings(), stage_to(stage_dir))
    gone = inputs(tables, "l_")
    for log in ("l_query_history", "l_audit", "l_job_runs", "l_usage"):
        gone[log] = gone[log].limit(0)
    again = lakehouse_report(gone, settings(), stage_to(stage_dir, resume=True))
    for name in ("job_totals", "daily_cost", "top_actors", "service_accounts", "platform_summary"):
        assert compare(spark_rows(again[name]), spark_rows(full[name])) is None
