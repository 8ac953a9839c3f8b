"""One row per platform, comparable across both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import bytes_to_gb, is_compute_sku, ms_to_seconds, safe_percent, sum_double, sum_long
from meterlens.functions.labels import ACTOR_PERSON, ACTOR_SERVICE, PERSON
from meterlens.operators.ranking import merge_one_row
from meterlens.operators.users import avg_daily_active_by
from meterlens.schemas import schema


def _constants(row: DataFrame, **values: Column) -> DataFrame:
    """Add constants to a one-row frame and put the columns of the summary in order."""
    order = [(f.name, f.dataType) for f in schema("platform_summary")]
    full = row.withColumns(values)
    return full.select(*[F.col(name).cast(kind) for name, kind in order])


def _count_of(inventory: DataFrame | None, alias: str, *kinds: str) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("object_type").isin(*kinds), F.col("count"))), F.lit(0)).alias(alias)]


def w_platform_summary(
    exec_stats: DataFrame,
    daily_active_by_type: DataFrame | None,
    storage_summary: DataFrame,
    cost_basis: DataFrame | None,
    cost_by_warehouse: DataFrame | None,
    object_inventory: DataFrame | None,
    task_rollup: DataFrame | None,
    lookback_days: int,
    generated_at: str,
    platform: str = "warehouse",
) -> DataFrame:
    """Totals are taken over all warehouses and tasks, not over the ranked ones.

    A missing source gives 0, a missing cost counts as an estimate.  Users of every type but
    ``PERSON`` are averaged as services.
    """
    parts = [
        exec_stats.agg(
            F.round(ms_to_seconds(sum_long("total_exec_ms")), 6).alias("total_compute_seconds"),
            sum_long("total_queries").alias("total_queries"),
            sum_long("failed_count").alias("failed_query_count"),
        ),
        storage_summary.select(F.round("total_active_gb", 6).alias("total_storage_gb")),
    ]
    missing: dict[str, Column] = {}
    if daily_active_by_type is not None:
        person = F.col("user_type") == PERSON
        kinds = {"active_users_human": person, "active_users_service": ~person}
        parts.append(avg_daily_active_by(daily_active_by_type, kinds, "active_users"))
    else:
        missing |= {"active_users_human": F.lit(0.0), "active_users_service": F.lit(0.0)}
    if cost_basis is not None and cost_by_warehouse is not None:
        parts += [
            cost_basis.select(F.col("total_usd").alias("total_cost_usd"), F.col("is_estimate").alias("cost_is_estimate")),
            cost_by_warehouse.agg(sum_double("usd").alias("compute_cost_usd")),
        ]
    else:
        missing |= {"total_cost_usd": F.lit(0.0), "cost_is_estimate": F.lit(True), "compute_cost_usd": F.lit(0.0)}
    if object_inventory is not None:
        parts.append(
            object_inventory.agg(
                *_count_of(object_inventory, "total_tables", "Tables", "Views"),
                *_count_of(object_inventory, "total_schemas", "Schemas"),
                *_count_of(object_inventory, "total_databases_or_catalogs", "Databases"),
            )
        )
    else:
        zeros = ("total_tables", "total_schemas", "total_databases_or_catalogs")
        missing |= {name: F.lit(0) for name in zeros}
    if task_rollup is not None:
        runs = task_rollup.agg(sum_long("total_runs").alias("runs"), sum_long("succeeded").alias("ok"))
        parts.append(
            runs.select(
                F.col("runs").alias("automation_run_count"),
                F.round(safe_percent("ok", "runs"), 6).alias("automation_success_rate_percent"),
            )
        )
    else:
        missing |= {"automation_run_count": F.lit(0), "automation_success_rate_percent": F.lit(0.0)}
    row = merge_one_row(*parts).withColumns(missing) if missing else merge_one_row(*parts)
    return _constants(
        row,
        platform=F.lit(platform),
        lookback_days=F.lit(lookback_days),
        generated_at=F.lit(generated_at),
        compute_cost_is_estimate=F.col("cost_is_estimate"),
        real_billed_discount_ratio=F.lit(None).cast("double"),
    )


def _list_costs(costs: DataFrame) -> DataFrame:
    """One row: list price of all days, and of compute SKUs, each rounded as its own table shows it."""
    sets = costs.groupingSets([["usage_date"], ["sku_name"]], "usage_date", "sku_name")
    shown = sets.agg(sum_double("usd").alias("usd"), F.grouping("usage_date").alias("_by_sku"))
    by_sku = F.col("_by_sku") == 1
    return shown.agg(
        sum_double(F.when(~by_sku, F.col("usd"))).alias("_list_usd"),
        sum_double(F.when(by_sku & is_compute_sku("sku_name"), F.col("usd"))).alias("compute_cost_usd"),
    )


def l_platform_summary(
    query_cube: DataFrame,
    daily_active_users: DataFrame,
    costs: DataFrame,
    object_inventory: DataFrame,
    catalog_schema_counts: DataFrame,
    storage: DataFrame | None,
    job_totals: DataFrame,
    real_billed: DataFrame | None,
    lookback_days: int,
    generated_at: str,
    platform: str = "lakehouse",
) -> DataFrame:
    """The total is the billed one if known; the compute share always stays a list-price estimate.

    ``query_cube`` and ``costs`` are the staged rollups (``l_query_cube``; priced usage by day and SKU): each is read
    by one aggregate, whatever number of measures it gives.  Without table sizes storage counts as 0.
    """

    def count_of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("object_type") == kind, F.col("object_count"))), F.lit(0))

    parts = [
        query_cube.agg(
            F.round(ms_to_seconds(sum_long("total_exec_ms")), 6).alias("total_compute_seconds"),
            sum_long("failed_count").alias("failed_query_count"),
            sum_long("query_count").alias("total_queries"),
        ),
        avg_daily_active_by(
            daily_active_users,
            {"active_users_human": F.col("actor_type") == ACTOR_PERSON, "active_users_service": F.col("actor_type") == ACTOR_SERVICE},
            "distinct_users",
        ),
        _list_costs(costs),
        object_inventory.agg(sum_long("object_count").alias("total_tables")),
        catalog_schema_counts.agg(
            count_of("CATALOG").alias("total_databases_or_catalogs"), count_of("SCHEMA").alias("total_schemas")
        ),
        job_totals.select(
            F.col("total_runs").alias("automation_run_count"),
            F.col("success_rate_percent").alias("automation_success_rate_percent"),
        ),
    ]
    if storage is not None:
        parts.append(storage.select(F.round(bytes_to_gb("total_size_bytes"), 6).alias("total_storage_gb")))
    if real_billed is not None:
        parts.append(real_billed.select(F.col("real_total_usd").alias("_real_usd")))
    row = merge_one_row(*parts)
    if storage is None:
        row = row.withColumn("total_storage_gb", F.lit(0.0))
    real = F.col("_real_usd") if real_billed is not None else F.lit(None).cast("double")
    return _constants(
        row,
        platform=F.lit(platform),
        lookback_days=F.lit(lookback_days),
        generated_at=F.lit(generated_at),
        total_cost_usd=F.coalesce(real, "_list_usd"),
        cost_is_estimate=real.isNull(),
        compute_cost_is_estimate=F.lit(True),
        real_billed_discount_ratio=F.round(real / F.nullif(F.col("_list_usd"), F.lit(0.0)), 6),
    )
