"""Object inventories, shares, transfers and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import Lookback, bytes_to_gb, cross_region_flag, not_deleted, policy_options, sum_long
from meterlens.operators.ranking import top_k
from meterlens.sources.tables import scan_shares_inventory

# fixed values: the object kinds of the warehouse inventory
OBJECT_KINDS = ("Databases", "Schemas", "Tables", "Views", "Stored Procedures", "Functions")


def w_object_inventory(objects: DataFrame) -> DataFrame:
    """Live objects per kind, 0 for a kind without any: one scan with a conditional count per kind."""
    live = objects.filter(not_deleted("deleted"))
    counts = live.agg(*[F.count_if(F.col("object_type") == kind).alias(kind) for kind in OBJECT_KINDS])
    return counts.unpivot([], [F.col(f"`{k}`") for k in OBJECT_KINDS], "object_type", "count")


def w_shares_summary(shares: DataFrame) -> DataFrame:
    kind = F.upper("kind")
    return shares.agg(
        F.count(F.lit(1)).alias("total_shares"),
        F.count_if(kind == "OUTBOUND").alias("outbound_shares"),
        F.count_if(kind == "INBOUND").alias("inbound_shares"),
    )


def w_shares_list(shares: DataFrame) -> DataFrame:
    return scan_shares_inventory(shares).orderBy("share_name")


_ROUTE = ("transfer_type", "source_cloud", "source_region", "target_cloud", "target_region")


def w_data_transfer(transfers: DataFrame, window: Lookback, limit: int = 20) -> DataFrame:
    routes = transfers.filter(window.ts("start_time")).groupBy(*_ROUTE).agg(sum_long("bytes_transferred").alias("bytes"))
    return top_k(routes, limit, "bytes", *_ROUTE).select(
        *_ROUTE, cross_region_flag(*_ROUTE[1:]).alias("cross_region"), bytes_to_gb("bytes").alias("total_gb")
    )


def w_data_transfer_total(transfers: DataFrame, window: Lookback) -> DataFrame:
    return transfers.filter(window.ts("start_time")).agg(bytes_to_gb(sum_long("bytes_transferred")).alias("total_gb"))


def w_lifecycle_policies(policies: DataFrame) -> DataFrame:
    tier, days = policy_options("options")
    return policies.filter(not_deleted("deleted_on")).select(
        F.col("name").alias("policy_name"),
        F.col("database").alias("database_name"),
        F.col("schema").alias("schema_name"),
        tier.alias("archive_tier"),
        days.alias("archive_for_days"),
    )


def w_lifecycle_policy_count(policies: DataFrame) -> DataFrame:
    return policies.filter(not_deleted("deleted_on")).agg(F.count(F.lit(1)).alias("policy_count"))


def l_object_inventory(tables: DataFrame) -> DataFrame:
    return tables.groupBy("table_type").agg(F.count(F.lit(1)).alias("object_count"))


def l_catalog_schema_counts(catalogs: DataFrame, schemata: DataFrame) -> DataFrame:
    def counted(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("object_count")).select(F.lit(kind).alias("object_type"), "object_count")

    return counted(catalogs, "CATALOG").unionByName(counted(schemata, "SCHEMA"))
