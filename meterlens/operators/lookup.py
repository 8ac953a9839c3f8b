"""Joins to dimensions.

Operators roll the log up before they come here, so both sides are small next to the log; no
size hint is given unless the rows themselves are bounded by a top-k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import compute_name

Pick = Callable[[str], Column]


def lookup_map(dimension: DataFrame, key: str, value: str, pick: Pick = F.max) -> DataFrame:
    """One row per key: a repeated key would multiply the rows it is joined to."""
    return dimension.filter(F.col(key).isNotNull()).groupBy(key).agg(pick(value).alias(value))


def attach(
    rows: DataFrame, key: str, dimension: DataFrame, dim_key: str, dim_value: str, alias: str, pick: Pick = F.max
) -> DataFrame:
    """Left join one dimension column on as ``alias``."""
    names = lookup_map(dimension, dim_key, dim_value, pick).select(
        F.col(dim_key).alias(f"_{alias}_key"), F.col(dim_value).alias(alias)
    )
    return rows.join(names, F.col(key) == F.col(f"_{alias}_key"), "left").drop(f"_{alias}_key")


def attach_to_top(
    rows: DataFrame, key: str, dimension: DataFrame, dim_key: str, dim_value: str, alias: str, pick: Pick = F.max
) -> DataFrame:
    """Like :func:`attach` for rows bounded by a top-k: the dimension is first cut down to their keys.

    Worth it where the dimension is itself folded from a large table.  The rows are read twice,
    which shares their shuffle only if the ranking needs every column of them.
    """
    wanted = F.broadcast(rows.select(F.col(key).alias(dim_key)).distinct())
    return attach(rows, key, dimension.join(wanted, dim_key, "left_semi"), dim_key, dim_value, alias, pick)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of a table is under its broadcast threshold; an unknown size is not."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return threshold >= 0 and int(size) <= threshold


def semi_filter(rows: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose key is among the members."""
    return rows.join(members.select(F.col(member).alias(key)).distinct(), key, "left_semi")


def with_compute_names(rollup: DataFrame, endpoints: DataFrame, clusters: DataFrame) -> DataFrame:
    """Resolve ``warehouse_id`` / ``cluster_id`` of a compute rollup to ``compute_id``.

    ``endpoints`` is (id, name), ``clusters`` is (cluster_id, cluster_name).
    """
    named = attach(rollup, "warehouse_id", endpoints, "id", "name", "_endpoint_name")
    named = attach(named, "cluster_id", clusters, "cluster_id", "cluster_name", "_cluster_name")
    return named.withColumn(
        "compute_id",
        compute_name("warehouse_id", "_endpoint_name", "cluster_id", "_cluster_name", "compute_type"),
    ).drop("_endpoint_name", "_cluster_name")


def dimension_lookups(
    runs: DataFrame, jobs: DataFrame, key: str = "job_id", name: str = "name", alias: str = "job_name"
) -> DataFrame:
    """Rows with the current name of their id, the id itself where no name is known."""
    return attach(runs, key, jobs, key, name, alias).withColumn(alias, F.coalesce(alias, key))
