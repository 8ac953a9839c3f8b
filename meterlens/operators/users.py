"""Users, service accounts and audit actors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import (
    Lookback,
    actor_type,
    bucket_people,
    classify_user_type,
    day_of,
    default_label,
    display_name,
    is_service_account,
    not_deleted,
    safe_ratio,
    sum_long,
)
from meterlens.operators.lookup import attach, semi_filter
from meterlens.operators.ranking import top_k


def user_type_lookup(daily_by_user: DataFrame, user_types: DataFrame, domain: str) -> DataFrame:
    """(day, user) activity with the type of the user; unknown users are classified by name alone."""
    typed = attach(daily_by_user, "user_name", user_types, "user_name", "user_type", "_raw_type")
    return typed.withColumn("user_type", classify_user_type("user_name", "_raw_type", domain)).drop("_raw_type")


def w_daily_volume_by_type(daily_by_user: DataFrame, user_types: DataFrame, domain: str) -> DataFrame:
    typed = user_type_lookup(daily_by_user, user_types, domain)
    return typed.groupBy("day", "user_type").agg(F.sum("query_count").alias("query_count"))


def w_daily_active_by_type(daily_by_user: DataFrame, user_types: DataFrame, domain: str) -> DataFrame:
    """One input row per (day, user), so counting rows counts users."""
    typed = user_type_lookup(daily_by_user, user_types, domain)
    return typed.groupBy("day", "user_type").agg(F.count(F.lit(1)).alias("active_users"))


def w_top_users(log: DataFrame, window: Lookback, domain: str, label: str, limit: int = 20) -> DataFrame:
    """Queries per user with employees in one bucket; bucketed before grouping, so nothing is over-fetched."""
    queries = log.filter(window.ts("start_time")).select("user_name", F.lit(1).alias("query_count"))
    return top_users_of(queries, domain, label, limit)


def top_users_of(counts: DataFrame, domain: str, label: str, limit: int = 20) -> DataFrame:
    """The same from any rollup with ``user_name`` and ``query_count``."""
    bucketed = counts.groupBy(bucket_people("user_name", domain, label).alias("user_name")).agg(
        sum_long("query_count").alias("query_count")
    )
    return top_k(bucketed, limit, "query_count", "user_name")


def w_active_user_count(users: DataFrame) -> DataFrame:
    enabled = ~F.coalesce(F.col("disabled"), F.lit(False))
    return users.filter(not_deleted("deleted_on") & enabled).agg(F.count(F.lit(1)).alias("active_users"))


# ---- service accounts --------------------------------------------------------


def service_users(user_types: DataFrame, domain: str) -> DataFrame:
    return user_types.filter(is_service_account("user_name", "user_type", domain)).select("user_name").distinct()


def service_account_filter(log: DataFrame, user_types: DataFrame, domain: str) -> DataFrame:
    """The log restricted to service accounts."""
    return semi_filter(log, "user_name", service_users(user_types, domain), "user_name")


def w_service_account_stats(log: DataFrame, user_types: DataFrame, window: Lookback, domain: str) -> DataFrame:
    """Rolled up per (user, warehouse) before the semi join: the raw log is never shuffled by user."""
    per_warehouse = (
        log.filter(window.ts("start_time") & F.col("user_name").isNotNull())
        .groupBy("user_name", "warehouse_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first"), F.max("start_time").alias("last"))
    )
    return _service_stats(per_warehouse, user_types, domain)


def service_account_stats_of(cube: DataFrame, user_types: DataFrame, domain: str) -> DataFrame:
    """The same from the query cube."""
    per_warehouse = cube.groupBy("user_name", "warehouse_name").agg(
        F.sum("query_count").alias("n"), F.min(F.to_date("day")).alias("first"), F.max(F.to_date("day")).alias("last")
    )
    return _service_stats(per_warehouse, user_types, domain)


def _service_stats(per_warehouse: DataFrame, user_types: DataFrame, domain: str) -> DataFrame:
    stats = service_account_filter(per_warehouse, user_types, domain).groupBy("user_name").agg(
        sum_long("n").alias("query_count"),
        F.count("warehouse_name").alias("warehouse_count"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    return stats.select(
        "user_name",
        "query_count",
        "warehouse_count",
        day_of("first").alias("first_day"),
        day_of("last").alias("last_day"),
    )


def service_account_summary(stats: DataFrame, user_action_counts: DataFrame | None = None) -> DataFrame:
    """Service-account statistics with the read and write counts of each account (0 without access data)."""
    if user_action_counts is None:
        return stats.withColumns({"read_count": F.lit(0).cast("long"), "write_count": F.lit(0).cast("long")})
    pivoted = user_action_counts.groupBy("user_name").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("action") == action, F.col("distinct_queries"))), F.lit(0)).alias(name)
            for action, name in (("READ", "read_count"), ("WRITE", "write_count"))
        ]
    )
    return stats.join(pivoted, "user_name", "left").fillna(0, ["read_count", "write_count"])


def l_service_account_stats(
    log: DataFrame, principals: DataFrame, window: Lookback, domain: str, label: str
) -> DataFrame:
    per_compute = (
        log.filter(window.ts("start_time") & ~F.col("executed_by").contains("@"))
        .groupBy("executed_by", F.coalesce("compute.warehouse_id", "compute.cluster_id").alias("compute"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first"), F.max("start_time").alias("last"))
    )
    return _service_accounts(per_compute, principals, domain, label)


def l_service_accounts_of(cube: DataFrame, principals: DataFrame, domain: str, label: str) -> DataFrame:
    """The same from the rollup by day, identity and compute."""
    per_compute = (
        cube.filter(~F.col("executed_by").contains("@"))
        .groupBy("executed_by", F.coalesce("warehouse_id", "cluster_id").alias("compute"))
        .agg(F.sum("query_count").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    return _service_accounts(per_compute, principals, domain, label)


def _service_accounts(per_compute: DataFrame, principals: DataFrame, domain: str, label: str) -> DataFrame:
    stats = per_compute.groupBy("executed_by").agg(
        F.sum("n").alias("query_count"),
        F.count("compute").alias("compute_count"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    return attach(stats, "executed_by", principals, "id", "name", "_name").select(
        display_name("executed_by", "_name", domain, label).alias("actor"),
        "query_count",
        "compute_count",
        day_of("first").alias("first_day"),
        day_of("last").alias("last_day"),
    )


# ---- audit -------------------------------------------------------------------


def l_audit_cube(audit: DataFrame, window: Lookback) -> DataFrame:
    """Actions per (day, e-mail, service): the one pass over the audit log that a report needs."""
    keys = F.to_date("event_time").alias("day"), F.col("user_identity.email").alias("email"), "service_name"
    return audit.filter(window.date("event_date")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def l_fold_audit(cube: DataFrame) -> DataFrame:
    return cube.groupBy("day", "email").agg(F.sum("n").alias("n"))


def l_services_of(cube: DataFrame) -> DataFrame:
    return cube.groupBy("service_name").agg(F.sum("n").alias("action_count"))


def l_audit_rollup(audit: DataFrame, window: Lookback) -> DataFrame:
    """Actions per (day, e-mail); daily users and top actors are folds of it."""
    return (
        audit.filter(window.date("event_date"))
        .groupBy(F.to_date("event_time").alias("day"), F.col("user_identity.email").alias("email"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def l_daily_active_users(audit_rollup: DataFrame) -> DataFrame:
    """The type follows from the e-mail, so rows of the rollup are distinct users per (day, type)."""
    daily = audit_rollup.groupBy("day", actor_type("email").alias("actor_type")).agg(
        F.count("email").alias("distinct_users"), sum_long("n").alias("action_count")
    )
    return daily.withColumn("day", day_of("day"))


def l_top_actors(
    audit_rollup: DataFrame, principals: DataFrame, domain: str, label: str, limit: int = 20
) -> DataFrame:
    """Actions per displayed identity: summed per raw identity, then named, then folded."""
    per_identity = audit_rollup.groupBy(default_label("email", "(unknown)").alias("identity")).agg(F.sum("n").alias("n"))
    named = attach(per_identity, "identity", principals, "id", "name", "_name")
    counts = named.groupBy(display_name("identity", "_name", domain, label).alias("actor")).agg(
        F.sum("n").alias("action_count")
    )
    return top_k(counts, limit, "action_count", "actor")


def l_actions_by_service(audit: DataFrame, window: Lookback) -> DataFrame:
    return audit.filter(window.date("event_date")).groupBy("service_name").agg(F.count(F.lit(1)).alias("action_count"))


# ---- averages ----------------------------------------------------------------


def avg_daily_active(daily: DataFrame, matches, value: str, alias: str) -> DataFrame:
    """Active users of the matching rows per day on which such rows exist; 0 if there are none."""
    return avg_daily_active_by(daily.filter(matches), {alias: F.lit(True)}, value)


def avg_daily_active_by(daily: DataFrame, kinds: Mapping[str, Column], value: str) -> DataFrame:
    """One row with such an average for each of several kinds, from one aggregate."""
    per_day = daily.groupBy("day").agg(
        *(F.sum(F.when(kind, F.col(value))).alias(f"_{alias}") for alias, kind in kinds.items()),
        *(F.max(F.when(kind, 1)).alias(f"_has_{alias}") for alias, kind in kinds.items()),
    )
    return per_day.agg(
        *(F.round(safe_ratio(F.coalesce(F.sum(f"_{alias}"), F.lit(0)), F.count(f"_has_{alias}")), 6).alias(alias) for alias in kinds)
    )
