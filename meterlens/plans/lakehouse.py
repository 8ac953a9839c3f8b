"""The lakehouse report: every ``l_`` measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import sum_double
from meterlens.operators import access, activity, ai_usage, automation, cost, inventory, storage, users
from meterlens.operators.ranking import densify_daily_series, merge_one_row, monthly_bill_pivot, top_n_with_other
from meterlens.plans.settings import Inputs, ReportSettings, Stage, no_stage
from meterlens.plans.summary import l_platform_summary
from meterlens.sources.files import table_sizes_from_files
from meterlens.sources.payloads import endpoint_names, principal_names
from meterlens.sources.tablelog import live_files
from meterlens.sources.tables import cluster_names, job_names

Report = dict[str, DataFrame | None]
TOP = 5  # groups that a share chart names, the rest is Other


def overview(query_totals: DataFrame, daily_cost: DataFrame, real_billed: DataFrame | None, lookback_days: int) -> DataFrame:
    """The headline row; the billed total is NULL where no export covers the window."""
    parts = [
        query_totals,
        daily_cost.agg(sum_double("usd").alias("total_cost_usd")),
    ]
    if real_billed is not None:
        parts.append(real_billed.select("real_total_usd"))
    row = merge_one_row(*parts).withColumn("lookback_days", F.lit(lookback_days))
    return row if real_billed is not None else row.withColumn("real_total_usd", F.lit(None).cast("double"))


def no_sizes(rows: DataFrame) -> DataFrame:
    """Table sizes where no manifest is given: none is known."""
    columns = {"qualified_name": "string", "format": "string", "num_files": "long", "size_bytes": "long"}
    return rows.limit(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()])


def lakehouse_report(inputs: Inputs, settings: ReportSettings, stage: Stage = no_stage) -> Report:
    """All lakehouse measures by name.

    Optional sources: the AI and ML tables, the tables' logs (or a file manifest), job payloads and the billed
    export (``l_billable``); a measure whose source is missing is ``None``.
    """
    domain, label, w = settings.domain, settings.employee_label, settings.window_of
    principals, endpoints = principal_names(inputs["l_principals"]), endpoint_names(inputs["l_endpoints"])
    clusters, jobs = cluster_names(inputs["l_clusters"]), job_names(inputs["l_jobs"])

    log, log_window = inputs["l_query_history"], w("l_query_history")
    # each log is folded once, and once more for sketches of durations; errors are read from the log itself
    durations = stage.days("duration_sketches", lambda window: activity.l_duration_sketches(log, window), log_window)
    cube = stage.days("query_cube", lambda window: activity.l_query_cube(log, window), log_window)
    compute, by_user = activity.l_fold_compute(cube), activity.l_fold_users(cube)
    # five cost tables, one pricing join
    costs = stage("cost_rollup", cost.l_cost_rollup(inputs["l_usage"], inputs["l_list_prices"], w("l_usage")), w("l_usage"))
    daily_cost, by_sku = cost.l_daily_cost(costs), cost.l_cost_by_sku(costs)
    monthly = cost.l_monthly_cost_by_sku(costs)
    user_cost = cost.l_user_cost(costs, principals, domain, label)
    billable = inputs.get("l_billable")
    real = None if billable is None else cost.l_real_billed_total(billable, daily_cost)

    audit_cube = stage("audit_cube", users.l_audit_cube(inputs["l_audit"], w("l_audit")), w("l_audit"))
    audit = users.l_fold_audit(audit_cube)
    lineage = stage("lineage_rollup", access.l_lineage_rollup(inputs["l_lineage"], w("l_lineage")), w("l_lineage"))
    job_cube = stage("job_cube", automation.l_job_cube(inputs["l_job_runs"], w("l_job_runs")), w("l_job_runs"))
    job_rollup = automation.l_fold_jobs(job_cube)
    # the log tells live files, a manifest is taken as it is
    table_log, manifest = inputs.get("l_table_log"), inputs.get("l_file_manifest")
    if table_log is not None:
        manifest = live_files(table_log)
    sizes = None if manifest is None else stage("table_sizes", table_sizes_from_files(manifest, inputs["l_tables"]))
    exec_stats = activity.l_compute_exec_stats(compute, endpoints, clusters)

    def given(table: str, build) -> DataFrame | None:
        df = inputs.get(table)
        return None if df is None else build(df, w(table))

    mlflow = None
    if inputs.get("l_runs") is not None and inputs.get("l_experiments") is not None:
        mlflow = ai_usage.l_mlflow_summary(inputs["l_experiments"], inputs["l_runs"], w("l_runs"))
    report: Report = {
        "query_totals": activity.query_totals(by_user, "executed_by"),
        "daily_query_volume": activity.daily_stats(by_user, "executed_by"),
        "daily_volume_by_type": activity.volume_by_actor_type(by_user),
        "daily_duration": activity.durations_of(durations, seconds=False),
        "monthly_duration": activity.durations_by_month(durations, seconds=False),
        "compute_exec_stats": exec_stats,
        "compute_signals": activity.l_compute_signals(compute, endpoints, clusters),
        "failure_rate": activity.failure_rate(exec_stats),
        "top_errors": activity.l_top_errors(log, log_window),
        "daily_cost": daily_cost,
        "cost_by_sku": by_sku,
        "cost_by_sku_top": top_n_with_other(by_sku.select("sku_name", "usd"), "sku_name", "usd", TOP),
        "daily_cost_by_product": cost.l_daily_cost_by_product(costs),
        "cost_by_user": cost.l_cost_by_user(user_cost),
        "top_users_by_cost": cost.l_top_users_by_cost(user_cost),
        "monthly_cost_by_sku": monthly,
        "monthly_bill_grid": monthly_bill_pivot(monthly, w("l_usage").months(), "sku", adjustments_apart=False),
        "real_billed_total": real,
        "discount": None if real is None else cost.l_discount(real, daily_cost),
        "daily_active_users": users.l_daily_active_users(audit),
        "daily_active_series": densify_daily_series(users.l_daily_active_users(audit), "actor_type", "distinct_users"),
        "top_actors": users.l_top_actors(audit, principals, domain, label),
        "actions_by_service": users.l_services_of(audit_cube),
        "actions_by_service_top": top_n_with_other(users.l_services_of(audit_cube), "service_name", "action_count", TOP),
        "top_read_tables": access.l_top_read_tables(lineage),
        "top_write_tables": access.l_top_write_tables(lineage),
        "user_table_reads": access.l_user_table_reads(lineage),
        "user_table_writes": access.l_user_table_writes(lineage),
        "service_accounts": users.l_service_accounts_of(cube, principals, domain, label),
        "service_account_tables": access.l_service_account_tables(lineage, principals, domain, label),
        # sizes are unknown without a manifest
        "table_access_detail": access.l_table_access_detail(
            lineage, principals, no_sizes(lineage) if sizes is None else sizes, domain, label
        ),
        "object_inventory": inventory.l_object_inventory(inputs["l_tables"]),
        "catalog_schema_counts": inventory.l_catalog_schema_counts(inputs["l_catalogs"], inputs["l_schemata"]),
        "job_runs": automation.l_job_runs(job_rollup, jobs),
        "job_totals": automation.l_job_totals(job_rollup),
        "daily_job_runs": automation.l_days_of_jobs(job_cube),
        "task_types": given("l_job_payloads", lambda df, _: automation.l_task_types(df, job_rollup)),
        "storage": None if sizes is None else storage.l_storage(sizes),
        "largest_tables": None if sizes is None else storage.l_largest_tables(sizes),
        "mlflow": mlflow,
        "serving_endpoints": given("l_served_entities", lambda df, _: ai_usage.l_serving_endpoints(df)),
        "serving_usage": given("l_endpoint_usage", ai_usage.l_serving_usage),
        "serving_endpoint_total": given(
            "l_served_entities", lambda df, _: ai_usage.l_serving_endpoint_total(ai_usage.l_serving_endpoints(df))
        ),
        "ai_gateway_totals": given("l_gateway_usage", lambda df, window: ai_usage.l_ai_gateway_totals(ai_usage.l_ai_gateway(df, window))),
        "ai_gateway": given("l_gateway_usage", ai_usage.l_ai_gateway),
        "quality_monitoring": given("l_quality_results", ai_usage.l_quality_monitoring),
        "classification": given("l_classification", lambda df, _: ai_usage.l_classification(df)),
    }
    days = settings.window.days
    report["overview"] = overview(report["query_totals"], daily_cost, real, days)
    report["platform_summary"] = l_platform_summary(
        cube,
        report["daily_active_users"],
        costs,
        report["object_inventory"],
        report["catalog_schema_counts"],
        report["storage"],
        report["job_totals"],
        real,
        days,
        settings.generated_at,
    )
    return report
