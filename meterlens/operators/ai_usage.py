"""Use of the platform's ML and AI services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import Lookback, count_where, default_label, not_deleted, safe_percent, sum_long


def _rows():
    return F.count(F.lit(1))


def scalar_subquery(rows: DataFrame, **scalars: DataFrame) -> DataFrame:
    """One-row aggregates of other tables next to ``rows``, each as an uncorrelated scalar sub-query."""
    return rows.select(*[df.scalar().alias(name) for name, df in scalars.items()], "*")


def l_mlflow_summary(experiments: DataFrame, runs: DataFrame, window: Lookback) -> DataFrame:
    current = experiments.filter(not_deleted("delete_time")).agg(_rows())
    in_window = runs.filter(window.ts("start_time")).agg(
        _rows().alias("total_runs"), count_where(F.col("status") == "FINISHED").alias("finished_runs")
    )
    return scalar_subquery(in_window, total_experiments=current)


def l_serving_endpoints(served_entities: DataFrame) -> DataFrame:
    return served_entities.filter(not_deleted("endpoint_delete_time")).groupBy("entity_type").agg(_rows().alias("count"))


def l_serving_endpoint_total(endpoint_types: DataFrame) -> DataFrame:
    return endpoint_types.agg(sum_long("count").alias("active_serving_endpoints"))


def l_serving_usage(endpoint_usage: DataFrame, window: Lookback) -> DataFrame:
    tokens = F.coalesce("input_token_count", F.lit(0)) + F.coalesce("output_token_count", F.lit(0))
    return endpoint_usage.filter(window.ts("request_time")).agg(
        _rows().alias("total_requests"), sum_long(tokens).alias("total_tokens")
    )


def l_ai_gateway(gateway_usage: DataFrame, window: Lookback) -> DataFrame:
    return (
        gateway_usage.filter(window.ts("event_time"))
        .groupBy(
            default_label("destination_type", "UNKNOWN").alias("destination_type"),
            default_label("destination_name", "UNKNOWN").alias("destination_name"),
        )
        .agg(_rows().alias("request_count"), sum_long("total_tokens").alias("total_tokens"))
    )


def l_ai_gateway_totals(gateway: DataFrame) -> DataFrame:
    return gateway.agg(
        sum_long("request_count").alias("request_count"), sum_long("total_tokens").alias("total_tokens")
    )


def l_quality_monitoring(results: DataFrame, window: Lookback) -> DataFrame:
    """Folded per table first, so the distinct count never gathers a hot table in one task."""
    per_table = (
        results.filter(window.ts("event_time"))
        .groupBy("table_id")
        .agg(_rows().alias("runs"), count_where(F.col("status") == "Healthy").alias("healthy"))
    )
    totals = per_table.agg(
        F.count("table_id").alias("tables_monitored"),
        sum_long("runs").alias("check_runs"),
        sum_long("healthy").alias("healthy_runs"),
    )
    return totals.withColumn("healthy_percent", F.round(safe_percent("healthy_runs", "check_runs"), 6))


def l_classification(results: DataFrame) -> DataFrame:
    per_table = results.groupBy("table_id").agg(_rows().alias("n"))
    return per_table.agg(sum_long("n").alias("total_results"), F.count("table_id").alias("tables_classified"))
