"""Storage: totals, largest tables, daily size per database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import Lookback, bytes_to_gb, day_of, not_deleted, qualified_name, sum_double, sum_long
from meterlens.operators.ranking import latest_snapshot, top_k, top_n_trend

# output column -> bytes column
STORAGE_CLASSES = {
    "total_active_gb": "active_bytes",
    "total_time_travel_gb": "time_travel_bytes",
    "total_failsafe_gb": "failsafe_bytes",
    "total_retained_for_clone_gb": "retained_for_clone_bytes",
}


def w_storage_summary(table_storage: DataFrame) -> DataFrame:
    """Bytes are added as decimals: those of a large platform are more than a long holds."""
    live = table_storage.filter(not_deleted("deleted", flag=True))
    return live.agg(*[bytes_to_gb(sum_double(c, digits=None)).alias(name) for name, c in STORAGE_CLASSES.items()])


def w_top_tables(table_storage: DataFrame, limit: int = 20) -> DataFrame:
    live = table_storage.filter(not_deleted("deleted", flag=True)).select(
        qualified_name("table_catalog", "table_schema", "table_name").alias("qualified_name"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("active_bytes", "time_travel_bytes", "failsafe_bytes")],
    )
    return top_k(live, limit, "active_bytes", "qualified_name").select(
        "qualified_name",
        bytes_to_gb("active_bytes").alias("active_gb"),
        bytes_to_gb("time_travel_bytes").alias("time_travel_gb"),
        bytes_to_gb("failsafe_bytes").alias("failsafe_gb"),
    )


def w_database_storage_trend(database_storage: DataFrame, window: Lookback, top: int = 6) -> DataFrame:
    """Daily size of the databases that are largest at their own latest date, the rest as ``Other``."""
    daily = (
        database_storage.filter(window.date("usage_date"))
        .groupBy("usage_date", "database_name")
        .agg(F.sum("average_database_bytes").alias("bytes"))
    )
    latest = latest_snapshot(daily, "database_name", "usage_date", "bytes")
    trend = top_n_trend(daily, "database_name", "bytes", top, ["usage_date"], latest, "bytes")
    return trend.select(
        day_of("usage_date").alias("day"), "database_name", F.round(bytes_to_gb("bytes"), 6).alias("avg_gb")
    )


def l_storage(table_sizes: DataFrame) -> DataFrame:
    """One row: bytes and number of all sized tables."""
    return table_sizes.agg(sum_long("size_bytes").alias("total_size_bytes"), F.count(F.lit(1)).alias("tables_counted"))


def l_largest_tables(table_sizes: DataFrame, limit: int = 20) -> DataFrame:
    return top_k(table_sizes, limit, "size_bytes", "qualified_name")
