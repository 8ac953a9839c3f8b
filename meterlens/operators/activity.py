"""Query activity: volume, duration, resources, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import (
    Lookback,
    actor_type,
    bytes_to_gb,
    count_where,
    day_of,
    default_label,
    error_class,
    ms_to_seconds,
    positive_duration,
    safe_percent,
    sample_message,
    seconds_to_hours,
    sum_double,
    sum_long,
)
from meterlens.operators.lookup import with_compute_names
from meterlens.operators.ranking import top_k, top_n_trend

QUARTILES = [0.25, 0.5, 0.75]
# Rank error of a quartile is at most 1 / accuracy.
QUARTILE_ACCURACY = 10_000


def _rows() -> Column:
    return F.count(F.lit(1))


def _with_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("day", F.to_date(ts))


def _day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", day_of("day"))


# ---- volume ------------------------------------------------------------------
#
# ``by_user`` rollups hold (day, user, query_count).  Every daily figure follows from one, so a
# report computes it once; counting its rows counts distinct users without a second distinct.


def _by_user(log: DataFrame, window: Lookback, user: str) -> DataFrame:
    rows = _with_day(log.filter(window.ts("start_time")), "start_time")
    return _day_text(rows.groupBy("day", user).agg(_rows().alias("query_count")))


def w_daily_query_by_user(log: DataFrame, window: Lookback) -> DataFrame:
    return _by_user(log, window, "user_name")


def l_daily_query_by_user(log: DataFrame, window: Lookback) -> DataFrame:
    return _by_user(log, window, "executed_by")


def daily_stats(by_user: DataFrame, user: str) -> DataFrame:
    return by_user.groupBy("day").agg(sum_long("query_count").alias("query_count"), F.count(user).alias("active_users"))


def query_totals(by_user: DataFrame, user: str) -> DataFrame:
    per_user = by_user.groupBy(user).agg(F.sum("query_count").alias("n"))
    return per_user.agg(sum_long("n").alias("total_queries"), F.count(user).alias("active_users"))


def volume_by_actor_type(by_user: DataFrame, user: str = "executed_by") -> DataFrame:
    return by_user.groupBy("day", actor_type(user).alias("actor_type")).agg(sum_long("query_count").alias("query_count"))


def w_daily_query_stats(log: DataFrame, window: Lookback) -> DataFrame:
    return daily_stats(w_daily_query_by_user(log, window), "user_name")


def l_daily_query_volume(log: DataFrame, window: Lookback) -> DataFrame:
    return daily_stats(l_daily_query_by_user(log, window), "executed_by")


def l_daily_volume_by_type(log: DataFrame, window: Lookback) -> DataFrame:
    return volume_by_actor_type(l_daily_query_by_user(log, window))


def l_overview(log: DataFrame, window: Lookback) -> DataFrame:
    return query_totals(log.filter(window.ts("start_time")).select("executed_by", F.lit(1).alias("query_count")), "executed_by")


def w_database_activity(log: DataFrame, window: Lookback) -> DataFrame:
    rows = log.filter(window.ts("start_time") & F.col("database_name").isNotNull())
    return _day_text(_with_day(rows, "start_time").groupBy("day", "database_name").agg(_rows().alias("query_count")))


def w_database_activity_trend(database_activity: DataFrame, top: int = 6) -> DataFrame:
    """Daily series of the busiest databases and one for all others."""
    return top_n_trend(database_activity, "database_name", "query_count", top, ["day"])


# ---- duration ----------------------------------------------------------------


def _daily_duration(log: DataFrame, window: Lookback, duration: str, accuracy: int) -> DataFrame:
    rows = _with_day(log.filter(window.ts("start_time") & positive_duration(duration)), "start_time")
    daily = rows.groupBy("day").agg(
        F.min(duration).alias("min_ms"),
        F.percentile_approx(duration, QUARTILES, accuracy).alias("q"),
        F.max(duration).alias("max_ms"),
    )
    return _day_text(daily).select(
        "day",
        "min_ms",
        F.col("q")[0].alias("q1_ms"),
        F.col("q")[1].alias("median_ms"),
        F.col("q")[2].alias("q3_ms"),
        "max_ms",
    )


def w_daily_duration(log: DataFrame, window: Lookback, accuracy: int = QUARTILE_ACCURACY) -> DataFrame:
    daily = _daily_duration(log, window, "execution_time", accuracy)
    measures = ("min", "q1", "median", "q3", "max")
    return daily.select("day", *[ms_to_seconds(f"{m}_ms").alias(f"{m}_seconds") for m in measures])


def l_daily_duration(log: DataFrame, window: Lookback, accuracy: int = QUARTILE_ACCURACY) -> DataFrame:
    return _daily_duration(log, window, "total_duration_ms", accuracy)


# ---- duration kept as sketches -------------------------------------------------
#
# Quartiles do not add up, sketches of durations do: a day's sketch is made once and kept, and a longer period is the
# merge of its days.  A quartile's rank is off by at most RANK_ERROR of the rows with a chance of 99 %; up to SKETCH_K
# rows it is exact.

SKETCH_K = 2000
RANK_ERROR = 0.003


def _duration_sketches(log: DataFrame, window: Lookback, duration: str) -> DataFrame:
    rows = _with_day(log.filter(window.ts("start_time") & positive_duration(duration)), "start_time")
    daily = rows.groupBy("day").agg(
        F.kll_sketch_agg_bigint(duration, SKETCH_K).alias("sketch"), F.min(duration).alias("min_ms"), F.max(duration).alias("max_ms")
    )
    return _day_text(daily)


def w_duration_sketches(log: DataFrame, window: Lookback) -> DataFrame:
    return _duration_sketches(log, window, "execution_time")


def l_duration_sketches(log: DataFrame, window: Lookback) -> DataFrame:
    return _duration_sketches(log, window, "total_duration_ms")


def durations_of(sketches: DataFrame, *keys: Column, seconds: bool) -> DataFrame:
    """Smallest, quartiles and largest duration per ``keys`` (by default the days), merged from the days' sketches."""
    merged = sketches.groupBy(*(keys or ("day",))).agg(
        F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("_sketch"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms")
    )
    quartiles = [F.kll_sketch_get_quantile_bigint("_sketch", F.lit(q)) for q in QUARTILES]
    names = [c for c in merged.columns if c not in ("_sketch", "min_ms", "max_ms")]
    measures = {"min": F.col("min_ms"), **dict(zip(("q1", "median", "q3"), quartiles, strict=True)), "max": F.col("max_ms")}
    if seconds:
        return merged.select(*names, *[ms_to_seconds(c).alias(f"{m}_seconds") for m, c in measures.items()])
    return merged.select(*names, *[c.alias(f"{m}_ms") for m, c in measures.items()])


def durations_by_month(sketches: DataFrame, seconds: bool) -> DataFrame:
    return durations_of(sketches, F.substring("day", 1, 7).alias("month"), seconds=seconds)


# ---- compute -----------------------------------------------------------------


def _query_measures() -> list[Column]:
    """Additive measures of the query log.

    Failed means any status but ``SUCCESS``; a NULL status is not failed.
    """
    spilled = F.col("bytes_spilled_to_local_storage") + F.col("bytes_spilled_to_remote_storage")
    queued = F.col("queued_provisioning_time") + F.col("queued_overload_time")
    failed = F.col("execution_status") != "SUCCESS"
    return [
        _rows().alias("query_count"),
        count_where(spilled > 0).alias("queries_with_spill"),
        sum_long(spilled).alias("total_spilled_bytes"),
        count_where(queued > 0).alias("queries_with_queueing"),
        sum_long(queued).alias("total_queued_ms"),
        sum_long("execution_time").alias("total_exec_ms"),
        count_where(failed).alias("failed_count"),
        sum_long(F.when(failed, F.col("execution_time"))).alias("failed_exec_ms"),
    ]


CUBE_KEYS = ("day", "user_name", "warehouse_name", "database_name")


def w_query_cube(log: DataFrame, window: Lookback) -> DataFrame:
    """The log folded to (day, user, warehouse, database): the one pass that a report needs.

    All measures add up, so volume, users, databases, warehouses and service accounts are folds
    of it; a hot user or warehouse is already reduced on the map side.
    """
    rows = _with_day(log.filter(window.ts("start_time")), "start_time")
    return _day_text(rows.groupBy(*CUBE_KEYS).agg(*_query_measures()))


def fold_cube(cube: DataFrame, *keys: str) -> DataFrame:
    measures = [c for c in cube.columns if c not in CUBE_KEYS]
    return cube.groupBy(*keys).agg(*[sum_long(m).alias(m) for m in measures])


def w_warehouse_rollup(log: DataFrame, window: Lookback) -> DataFrame:
    """One pass over the log for the resource and the execution measures of every warehouse."""
    return log.filter(window.ts("start_time")).groupBy("warehouse_name").agg(*_query_measures())


def w_resource_signals(rollup: DataFrame, limit: int = 15) -> DataFrame:
    """Warehouses that spilled or queued, those with the most affected queries first."""
    hit = rollup.filter((F.col("total_spilled_bytes") > 0) | (F.col("total_queued_ms") > 0))
    ranked = top_k(hit, limit, F.col("queries_with_spill") + F.col("queries_with_queueing"), "warehouse_name")
    return ranked.select(
        "warehouse_name",
        "query_count",
        "queries_with_spill",
        bytes_to_gb("total_spilled_bytes").alias("total_spilled_gb"),
        "queries_with_queueing",
        ms_to_seconds("total_queued_ms").alias("total_queued_seconds"),
    )


def w_exec_stats(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "warehouse_name", F.col("query_count").alias("total_queries"), "total_exec_ms", "failed_count", "failed_exec_ms"
    )


def w_failed_waste(exec_stats: DataFrame, limit: int | None = 15) -> DataFrame:
    """Time spent on failed queries per warehouse; ``limit=None`` keeps every warehouse for totals."""
    waste = exec_stats.filter(F.col("failed_count") > 0).select(
        "warehouse_name",
        F.col("failed_count").alias("failed_query_count"),
        ms_to_seconds("failed_exec_ms").alias("wasted_seconds"),
    )
    return waste if limit is None else top_k(waste, limit, "wasted_seconds", "warehouse_name")


COMPUTE_KEYS = ("compute_type", "warehouse_id", "cluster_id")


def _compute_keys() -> list[Column]:
    return [F.col(f"compute.{c}").alias(k) for c, k in zip(("type", "warehouse_id", "cluster_id"), COMPUTE_KEYS, strict=True)]


def _compute_measures() -> list[Column]:
    """Additive measures of the query log; failed means status ``FAILED``."""
    failed = F.col("execution_status") == "FAILED"
    return [
        _rows().alias("query_count"),
        sum_long("total_duration_ms").alias("total_exec_ms"),
        count_where(failed).alias("failed_count"),
        sum_long(F.when(failed, F.col("total_duration_ms"))).alias("failed_exec_ms"),
        count_where(F.col("spilled_local_bytes") > 0).alias("queries_with_spill"),
        sum_long("spilled_local_bytes").alias("total_spilled_bytes"),
        count_where(F.col("waiting_for_compute_duration_ms") > 0).alias("queries_with_queueing"),
        sum_long("waiting_for_compute_duration_ms").alias("total_queued_ms"),
    ]


def l_compute_rollup(log: DataFrame, window: Lookback) -> DataFrame:
    """One pass over the log for both measures of every compute."""
    return log.filter(window.ts("start_time")).groupBy(*_compute_keys()).agg(*_compute_measures())


def l_query_cube(log: DataFrame, window: Lookback) -> DataFrame:
    """The log folded to (day, identity, compute): the one pass that a report needs.

    Volume, users, computes and service accounts are folds of it.
    """
    rows = _with_day(log.filter(window.ts("start_time")), "start_time")
    ends = F.min("start_time").alias("first"), F.max("start_time").alias("last")
    return _day_text(rows.groupBy("day", "executed_by", *_compute_keys()).agg(*_compute_measures(), *ends))


def l_fold_compute(cube: DataFrame) -> DataFrame:
    measures = [c for c in cube.columns if c not in ("day", "executed_by", "first", "last", *COMPUTE_KEYS)]
    return cube.groupBy(*COMPUTE_KEYS).agg(*[sum_long(m).alias(m) for m in measures])


def l_fold_users(cube: DataFrame) -> DataFrame:
    return cube.groupBy("day", "executed_by").agg(sum_long("query_count").alias("query_count"))


def l_compute_exec_stats(rollup: DataFrame, endpoints: DataFrame, clusters: DataFrame) -> DataFrame:
    return with_compute_names(rollup, endpoints, clusters).select(
        "compute_id",
        "compute_type",
        F.col("query_count").alias("total_queries"),
        "total_exec_ms",
        "failed_count",
        "failed_exec_ms",
    )


def l_compute_signals(rollup: DataFrame, endpoints: DataFrame, clusters: DataFrame) -> DataFrame:
    return with_compute_names(rollup, endpoints, clusters).select(
        "compute_id",
        "compute_type",
        "query_count",
        "queries_with_spill",
        "total_spilled_bytes",
        "queries_with_queueing",
        "total_queued_ms",
    )


# ---- failures ----------------------------------------------------------------


def _top_errors(failed: DataFrame, reason: Column, name: str, limit: int, message: Column) -> DataFrame:
    """Reasons are counted by a hash aggregate, then messages of the ``limit`` that lead are looked at.

    Equal messages are folded first; that narrow shuffle is what counts and samples both read, so the log is read
    once.  The sample is the smallest message, which is stable.  Minimums of text need a sort, which so meets
    the messages of a few reasons only.
    """
    reasons = failed.select(reason.alias(name), message.alias("sample_message"))
    folded = reasons.groupBy(name, "sample_message").agg(_rows().alias("n"))
    top = top_k(folded.groupBy(name).agg(sum_long("n").alias("count")), limit, "count", name)
    marks = F.broadcast(top.select(F.col(name).alias("_top")))
    # not a semi join, which would be pushed below the fold, and counted again: so both sides ask the same of the
    # shuffle and share it
    led = folded.join(marks, F.col(name).eqNullSafe(F.col("_top")))
    samples = led.groupBy(name).agg(F.min("sample_message").alias("sample_message"), sum_long("n").alias("count"))
    return top_k(samples.select(name, "sample_message", "count"), limit, "count", name)


def w_top_errors(log: DataFrame, window: Lookback, limit: int = 15) -> DataFrame:
    failed = log.filter(window.ts("start_time") & (F.col("execution_status") != "SUCCESS"))
    # cut to the length that is shown before the minimum, which gives the same one
    cut = F.when(F.col("error_message").isNotNull(), sample_message("error_message"))
    top = _top_errors(failed, default_label("error_code", "UNKNOWN"), "error_code", limit, cut)
    return top.withColumn("sample_message", sample_message("sample_message"))


def l_top_errors(log: DataFrame, window: Lookback, limit: int = 15) -> DataFrame:
    failed = log.filter(window.ts("start_time") & (F.col("execution_status") == "FAILED"))
    return _top_errors(failed, error_class("error_message"), "error_class", limit, F.col("error_message"))


def failure_rate(exec_stats: DataFrame) -> DataFrame:
    """One row: failed share of all queries and the hours they burned."""
    totals = exec_stats.agg(
        sum_long("total_queries").alias("total_queries"),
        sum_long("failed_count").alias("failed_queries"),
        sum_long("failed_exec_ms").alias("failed_exec_ms"),
    )
    return totals.select(
        "total_queries",
        "failed_queries",
        F.round(safe_percent("failed_queries", "total_queries"), 6).alias("failure_rate_percent"),
        F.round(seconds_to_hours(ms_to_seconds("failed_exec_ms")), 6).alias("wasted_hours"),
    )


# ---- credits -----------------------------------------------------------------


def w_daily_credits(metering: DataFrame, window: Lookback) -> DataFrame:
    rows = _with_day(metering.filter(window.ts("start_time")), "start_time")
    return _day_text(rows.groupBy("day").agg(sum_double("credits_used").alias("credits")))


def w_total_credits(metering: DataFrame, window: Lookback) -> DataFrame:
    return metering.filter(window.ts("start_time")).agg(sum_double("credits_used").alias("total_credits"))


def w_credits_by_warehouse(metering: DataFrame, window: Lookback, limit: int | None = 15, digits: int | None = 6) -> DataFrame:
    credits = (
        metering.filter(window.ts("start_time"))
        .groupBy("warehouse_name")
        .agg(sum_double("credits_used", digits).alias("total_credits"))
    )
    return credits if limit is None else top_k(credits, limit, "total_credits", "warehouse_name")
