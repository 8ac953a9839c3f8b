"""The warehouse report: every ``w_`` measure that the given sources allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import Lookback, sum_double, sum_long
from meterlens.operators import access, activity, automation, cost, inventory, logins, storage, users
from meterlens.operators.ranking import cumulative_cost, data_span, merge_one_row, monthly_bill_pivot, top_k, top_n_with_other
from meterlens.plans.settings import Inputs, ReportSettings, Stage, no_stage
from meterlens.plans.summary import w_platform_summary
from meterlens.sources.tables import user_types

Report = dict[str, DataFrame | None]
TOP = 5  # groups that a share chart names, the rest is Other


def overview(
    daily_query_stats: DataFrame,
    total_credits: DataFrame,
    cost_basis: DataFrame | None,
    active_user_count: DataFrame,
    storage_summary: DataFrame,
    fallback_days: int,
) -> DataFrame:
    """The headline row; cost is shown where it is known, credits where not."""
    headline = total_credits.select(F.lit("credits").alias("headline"), F.col("total_credits").alias("headline_value"))
    if cost_basis is not None:
        kind = F.when(F.col("is_estimate"), "estimated cost").otherwise("cost")
        headline = cost_basis.select(kind.alias("headline"), F.col("total_usd").alias("headline_value"))
    return merge_one_row(
        data_span(daily_query_stats, fallback_days),
        daily_query_stats.agg(sum_long("query_count").alias("total_queries")),
        headline,
        active_user_count,
        storage_summary.select(F.round("total_active_gb", 6).alias("active_gb")),
    )


def _activity(inputs: Inputs, settings: ReportSettings, stage: Stage) -> Report:
    log, window = inputs["w_query_history"], settings.window_of("w_query_history")
    metering, metering_window = inputs["w_metering"], settings.window_of("w_metering")
    cube = stage.days("query_cube", lambda days: activity.w_query_cube(log, days), window)
    durations = stage.days("duration_sketches", lambda days: activity.w_duration_sketches(log, days), window)
    by_user = cube.groupBy("day", "user_name").agg(sum_long("query_count").alias("query_count"))
    by_warehouse = activity.fold_cube(cube, "warehouse_name")
    with_database = cube.filter(F.col("database_name").isNotNull())
    by_database = with_database.groupBy("day", "database_name").agg(sum_long("query_count").alias("query_count"))
    credits = stage(
        "credits_by_warehouse", activity.w_credits_by_warehouse(metering, metering_window, limit=None, digits=None), metering_window
    )
    exec_stats = activity.w_exec_stats(by_warehouse)
    return {
        "query_cube": cube,
        "daily_query_by_user": by_user,
        "daily_query_stats": activity.daily_stats(by_user, "user_name"),
        "top_users": users.top_users_of(by_user, settings.domain, settings.employee_label),
        "database_activity": by_database,
        "database_activity_trend": activity.w_database_activity_trend(by_database),
        "resource_signals": activity.w_resource_signals(by_warehouse),
        "exec_stats": exec_stats,
        "failed_waste": activity.w_failed_waste(exec_stats),
        "failure_rate": activity.failure_rate(exec_stats),
        "top_errors": activity.w_top_errors(log, window),
        "daily_duration": activity.durations_of(durations, seconds=True),
        "monthly_duration": activity.durations_by_month(durations, seconds=True),
        "daily_credits": activity.w_daily_credits(metering, metering_window),
        "all_credits_by_warehouse": credits,
        "credits_by_warehouse": top_k(credits, 15, "total_credits", "warehouse_name").withColumn("total_credits", F.round("total_credits", 6)),
        "total_credits": credits.agg(sum_double("total_credits").alias("total_credits")),
        "active_user_count": users.w_active_user_count(inputs["w_users"]),
    }


def _types(inputs: Inputs, report: Report, settings: ReportSettings) -> Report:
    """Splits by user type and service accounts; they need to know the types of users."""
    if inputs.get("w_user_types") is None:
        return {"daily_volume_by_type": None, "daily_active_by_type": None, "service_accounts": None}
    types, by_user = inputs["w_user_types"], report["daily_query_by_user"]
    stats = users.service_account_stats_of(report["query_cube"], types, settings.domain)
    return {
        "daily_volume_by_type": users.w_daily_volume_by_type(by_user, types, settings.domain),
        "daily_active_by_type": users.w_daily_active_by_type(by_user, types, settings.domain),
        "service_accounts": users.service_account_summary(stats, report.get("user_action_counts")),
    }


def _access(inputs: Inputs, settings: ReportSettings, stage: Stage) -> Report:
    history, tables = inputs.get("w_access_history"), inputs["w_table_storage"]
    if history is None:
        names = ("table_access_counts", "user_action_counts", "dead_tables", "size_vs_access", "table_access_detail")
        return dict.fromkeys(names)
    flat = access.access_events(history, settings.window_of("w_access_history"))
    # every measure counts distinct queries, so repeated touches go before staging; the one shuffle by query
    # serves all of them
    events = stage.keyed("access_events", flat, "query_id")
    counts = access.w_table_access_counts(events)
    report: Report = {
        "table_access_counts": access.w_top_accessed_tables(counts),
        "user_action_counts": access.w_user_action_counts(events),
        "table_rw_by_user": access.w_table_rw_by_user(events),
        "dead_tables": access.dead_tables(tables, events),
        "size_vs_access": access.size_vs_access(tables, events),
        "table_access_detail": access.w_table_access_detail(tables, events, settings.domain, settings.employee_label),
        "service_account_tables": None,
    }
    if inputs.get("w_user_types") is not None:
        report["service_account_tables"] = access.w_user_table_counts(events, inputs["w_user_types"], settings.domain)
    return report


def _cost(inputs: Inputs, report: Report, settings: ReportSettings) -> Report:
    """Billed where billing is readable, estimated where prices are given, else no cost section."""
    billing, window = inputs.get("w_billing"), settings.window_of("w_billing")
    total_credits, storage_summary = report["total_credits"], report["storage_summary"]
    bill = None if billing is None else cost.billed(billing, window, settings.account, settings.currency)
    basis = cost.w_cost_basis(bill, total_credits, storage_summary, settings.credit_price, settings.storage_price_per_tb)
    if basis is None:
        return {"cost_basis": None, "daily_cost": None, "cost_by_type": None, "all_cost_by_warehouse": None}
    if bill is not None:
        monthly = cost.w_monthly_bill(bill)
        section: Report = {
            "daily_cost": cost.w_daily_cost(bill),
            "cost_by_type": cost.w_cost_by_type(bill),
            "monthly_bill": monthly,
            "monthly_bill_grid": monthly_bill_pivot(monthly, window.months(), "usage_type"),
        }
        rate: cost.Rate = cost.w_rate_per_credit(bill, total_credits)
    else:
        rate = settings.credit_price or 0.0
        section = {
            "daily_cost": cost.w_estimated_daily_cost(report["daily_credits"], rate),
            "cost_by_type": cost.w_estimated_cost(
                total_credits, storage_summary, rate, settings.storage_price_per_tb or 0.0
            ),
            "monthly_bill": None,
            "monthly_bill_grid": None,
        }
    section |= {
        "cost_basis": basis,
        "cumulative_cost": cumulative_cost(section["daily_cost"]),
        "all_cost_by_warehouse": cost.w_cost_by_warehouse(report["all_credits_by_warehouse"], rate),
        "cost_by_warehouse": cost.w_cost_by_warehouse(report["credits_by_warehouse"], rate),
        "wasted_compute_cost": cost.wasted_compute_cost(report["exec_stats"], report["all_credits_by_warehouse"], rate),
        "cost_by_user": None,
        "top_users_by_cost": None,
    }
    section["cost_by_type_top"] = top_n_with_other(section["cost_by_type"], "usage_type", "usd", TOP)
    section["cost_by_warehouse_top"] = top_n_with_other(section["all_cost_by_warehouse"].select("warehouse_name", "usd"), "warehouse_name", "usd", TOP)
    if inputs.get("w_attribution") is not None:
        user_cost = cost.w_user_cost(
            inputs["w_attribution"], rate, settings.window_of("w_attribution"), settings.domain, settings.employee_label
        )
        section |= {
            "cost_by_user": cost.w_cost_by_user(user_cost),
            "top_users_by_cost": cost.w_top_users_by_cost(user_cost),
        }
    return section


def _optional(inputs: Inputs, settings: ReportSettings) -> Report:
    """Sections that stand on one optional source each."""

    def given(table: str, build) -> DataFrame | None:
        df = inputs.get(table)
        return None if df is None else build(df, settings.window_of(table))

    policies = inputs.get("network_policies")

    def by_channel(log: DataFrame, window: Lookback) -> DataFrame | None:
        if policies is None:
            return None
        return logins.w_logins_by_channel(logins.login_channel(logins.logins_by_ip(log, window), policies))

    def top(rows: DataFrame | None, key: str, value: str) -> DataFrame | None:
        return None if rows is None else top_n_with_other(rows, key, value, TOP)

    tasks = given("w_task_history", automation.w_task_rollup)
    sessions = given("w_sessions", logins.w_sessions_by_client)
    channels, client_types = given("w_login_history", by_channel), given("w_login_history", logins.w_logins_by_client_type)
    shares = None
    if channels is not None and client_types is not None and settings.watched_login is not None:
        shares = logins.login_shares(channels, client_types, *settings.watched_login)
    return {
        "task_rollup": tasks,
        "task_runs": None if tasks is None else automation.w_task_runs(tasks),
        "pipe_ingest": given("w_pipe_usage", automation.w_pipe_ingest),
        "streams": given("w_streams", lambda df, _: automation.w_streams_summary(df)),
        "shares": given("w_shares", lambda df, _: inventory.w_shares_summary(df)),
        "share_list": given("w_shares", lambda df, _: inventory.w_shares_list(df)),
        "mv_refresh": given("w_mv_refresh", automation.w_mv_refresh),
        "data_transfer": given("w_data_transfer", inventory.w_data_transfer),
        "data_transfer_total": given("w_data_transfer", inventory.w_data_transfer_total),
        "object_inventory": given("w_objects", lambda df, _: inventory.w_object_inventory(df)),
        "sessions_by_client": sessions,
        "sessions_by_client_top": top(sessions, "client_application_id", "session_count"),
        "lifecycle_policy_count": given("w_lifecycle", lambda df, _: inventory.w_lifecycle_policy_count(df)),
        "lifecycle_policies": given("w_lifecycle", lambda df, _: inventory.w_lifecycle_policies(df)),
        "logins_by_channel": channels,
        "logins_by_channel_top": top(channels, "channel", "login_count"),
        "logins_by_client_type": client_types,
        "logins_by_client_type_top": top(client_types, "client_type", "login_count"),
        "login_shares": shares,
        "login_total": given("w_login_history", logins.w_login_total),
        "auth_factors": given("w_login_history", logins.w_auth_factors),
        "replication_usage": given("w_replication", automation.w_replication_usage),
    }


def warehouse_report(inputs: Inputs, settings: ReportSettings, stage: Stage = no_stage) -> Report:
    """All warehouse measures by name; ``None`` marks one whose source is missing.

    Required: ``w_users``, ``w_query_history``, ``w_metering``, ``w_table_storage``,
    ``w_database_storage``.  ``w_user_types`` defaults to the types in ``w_users`` if it has them.
    """
    inputs = dict(inputs)
    if "w_user_types" not in inputs and "user_type" in inputs["w_users"].columns:
        inputs["w_user_types"] = user_types(inputs["w_users"])
    report = _activity(inputs, settings, stage)
    report |= {
        "storage_summary": storage.w_storage_summary(inputs["w_table_storage"]),
        "top_tables": storage.w_top_tables(inputs["w_table_storage"]),
        "database_storage_trend": storage.w_database_storage_trend(
            inputs["w_database_storage"], settings.window_of("w_database_storage")
        ),
    }
    report |= _access(inputs, settings, stage)
    report |= _types(inputs, report, settings)
    report |= _cost(inputs, report, settings)
    report |= _optional(inputs, settings)
    days = settings.window.days
    report["overview"] = overview(
        report["daily_query_stats"],
        report["total_credits"],
        report["cost_basis"],
        report["active_user_count"],
        report["storage_summary"],
        days,
    )
    report["platform_summary"] = w_platform_summary(
        report["exec_stats"],
        report["daily_active_by_type"],
        report["storage_summary"],
        report["cost_basis"],
        report["all_cost_by_warehouse"],
        report["object_inventory"],
        report["task_rollup"],
        days,
        settings.generated_at,
    )
    return report
