"""Both platforms side by side, and what one side's workload would cost at the other's rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import safe_percent, safe_ratio
from meterlens.operators.ranking import merge_one_row

MISMATCH_DAYS = 2


def paired(w: DataFrame, l: DataFrame) -> DataFrame:
    """Both one-row summaries as one row with ``w_`` and ``l_`` columns."""

    def prefixed(df: DataFrame, side: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])

    return merge_one_row(prefixed(w, "w"), prefixed(l, "l"))


def lookback_mismatch(w: DataFrame, l: DataFrame, tolerance: int = MISMATCH_DAYS) -> DataFrame:
    """One row: do the windows differ by more than the tolerance, and a warning if so."""
    days = paired(w, l).select("w_lookback_days", "l_lookback_days")
    mismatch = F.abs(F.col("w_lookback_days") - F.col("l_lookback_days")) > tolerance
    message = F.format_string(
        "The windows differ: %d days against %d days. Volumes are not comparable until both cover the same days.",
        "w_lookback_days",
        "l_lookback_days",
    )
    return days.withColumns({"mismatch": mismatch, "message": F.when(mismatch, message)})


def migration_projection(w: DataFrame, l: DataFrame) -> DataFrame:
    """The warehouse's compute seconds at the lakehouse's observed price per second."""
    both = paired(w, l).withColumn("_rate", safe_ratio("l_compute_cost_usd", "l_total_compute_seconds"))
    projected = F.col("w_total_compute_seconds") * F.col("_rate")
    ratio = F.col("l_real_billed_discount_ratio")
    return both.select(
        F.col("w_total_compute_seconds").alias("compute_seconds"),
        F.col("w_compute_cost_usd"),
        F.round("_rate", 9).alias("l_rate_per_second"),
        F.round(projected, 6).alias("projected_usd"),
        F.round(projected * ratio, 6).alias("projected_usd_adjusted"),
        ratio.alias("ratio_applied"),
    )


def _delta(projected: str) -> tuple[Column, Column]:
    cost = F.col("w_compute_cost_usd")
    known = (cost > 0) & F.col(projected).isNotNull()
    percent = F.abs((F.col(projected) - cost) / cost * 100.0)
    return F.when(known, F.round(percent, 6)), F.when(known, F.when(F.col(projected) >= cost, "more").otherwise("less"))


def projection_delta(projection: DataFrame) -> DataFrame:
    """One row: how much more or less the projection is than today's cost; NULL if there is no cost."""
    percent, direction = _delta("projected_usd")
    adjusted_percent, adjusted_direction = _delta("projected_usd_adjusted")
    return projection.select(
        percent.alias("delta_percent"),
        direction.alias("direction"),
        adjusted_percent.alias("adjusted_delta_percent"),
        adjusted_direction.alias("adjusted_direction"),
    )


def _basis(estimate: str) -> Column:
    return F.when(F.col(estimate), "estimate").otherwise("real")


def comparison_table(w: DataFrame, l: DataFrame) -> DataFrame:
    """(metric, both values, the basis of money values) for every metric both sides know."""
    both = paired(w, l)
    none = F.lit(None).cast("string")

    def row(metric: str, w_value: Column, l_value: Column, w_basis: Column = none, l_basis: Column = none) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            w_value.cast("double").alias("w_value"),
            l_value.cast("double").alias("l_value"),
            w_basis.alias("w_basis"),
            l_basis.alias("l_basis"),
        )

    def same(metric: str, field: str) -> Column:
        return row(metric, F.col(f"w_{field}"), F.col(f"l_{field}"))

    def failure(side: str) -> Column:
        return F.round(safe_percent(f"{side}_failed_query_count", f"{side}_total_queries"), 6)

    rate = safe_ratio("l_compute_cost_usd", "l_total_compute_seconds")
    projected = F.col("w_total_compute_seconds") * rate
    w_compute = F.col("w_compute_cost_usd")
    w_compute_basis = _basis("w_compute_cost_is_estimate")
    estimate = F.lit("estimate")
    rows = [
        same("lookback_days", "lookback_days"),
        same("total_queries", "total_queries"),
        row("total_cost_usd", F.col("w_total_cost_usd"), F.col("l_total_cost_usd"), _basis("w_cost_is_estimate"), _basis("l_cost_is_estimate")),
        row("compute_cost_usd", w_compute, F.col("l_compute_cost_usd"), w_compute_basis, _basis("l_compute_cost_is_estimate")),
        row("workload_compute_seconds", F.col("w_total_compute_seconds"), F.col("w_total_compute_seconds")),
        row("observed_compute_cost_or_rate", w_compute, F.round(rate, 9), w_compute_basis, estimate),
        row("projected_cost_usd", w_compute, F.round(projected, 6), w_compute_basis, estimate),
        row("projected_cost_adjusted_usd", F.lit(None), F.round(projected * F.col("l_real_billed_discount_ratio"), 6), none, estimate),
        same("failed_queries", "failed_query_count"),
        row("failure_rate_percent", failure("w"), failure("l")),
        same("total_compute_seconds", "total_compute_seconds"),
        same("avg_daily_person_users", "active_users_human"),
        same("avg_daily_service_users", "active_users_service"),
        same("total_storage_gb", "total_storage_gb"),
        same("automation_runs", "automation_run_count"),
        same("automation_success_percent", "automation_success_rate_percent"),
        same("databases_or_catalogs", "total_databases_or_catalogs"),
        same("schemas", "total_schemas"),
        same("tables_and_views", "total_tables"),
    ]
    table = both.select(F.inline(F.array(*rows)))
    # without an observed discount there is no adjusted projection to show
    return table.filter((F.col("metric") != "projected_cost_adjusted_usd") | F.col("l_value").isNotNull())


def comparison_report(w: DataFrame, l: DataFrame) -> dict[str, DataFrame]:
    """All comparisons of two summaries, as read from the JSON of both reports."""
    projection = migration_projection(w, l)
    return {
        "lookback_mismatch": lookback_mismatch(w, l),
        "migration_projection": projection,
        "projection_delta": projection_delta(projection),
        "comparison_table": comparison_table(w, l),
    }
