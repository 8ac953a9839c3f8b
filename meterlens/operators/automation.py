"""Scheduled work: tasks, pipes, jobs, view refreshes, replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import (
    Lookback,
    bytes_to_gb,
    classify_statement,
    count_where,
    day_of,
    friendly_task_type,
    safe_percent,
    seconds_to_hours,
    sum_double,
    sum_long,
)
from meterlens.operators.lookup import attach
from meterlens.operators.ranking import top_k
from meterlens.sources.payloads import job_tasks_from_json
from meterlens.sources.tables import scan_streams_inventory


def w_task_rollup(task_history: DataFrame, window: Lookback) -> DataFrame:
    """Runs per task; its type is that of its earliest run (by name where runs start together).

    The log is folded per (task, type) with a hash aggregate; only those few rows are ranked by time.
    """
    per_type = (
        task_history.filter(window.ts("scheduled_time"))
        .groupBy("task_name", classify_statement("query_text").alias("task_type"))
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            count_where(F.col("state") == "SUCCEEDED").alias("succeeded"),
            count_where(F.col("state") == "FAILED").alias("failed"),
            F.min("scheduled_time").alias("first_run"),
        )
    )
    return per_type.groupBy("task_name").agg(
        F.min_by("task_type", F.struct("first_run", "task_type")).alias("task_type"),
        *[F.sum(c).alias(c) for c in ("total_runs", "succeeded", "failed")],
    )


def w_task_runs(task_rollup: DataFrame, limit: int = 20) -> DataFrame:
    return top_k(task_rollup, limit, "total_runs", "task_name")


def w_pipe_ingest(pipe_usage: DataFrame, window: Lookback, limit: int = 20) -> DataFrame:
    pipes = (
        pipe_usage.filter(window.ts("start_time"))
        .groupBy("pipe_name")
        .agg(
            sum_double("credits_used").alias("total_credits"),
            sum_long("files_inserted").alias("total_files_inserted"),
            sum_long("bytes_inserted").alias("bytes"),
        )
    )
    return top_k(pipes, limit, "total_credits", "pipe_name").select(
        "pipe_name", "total_credits", "total_files_inserted", bytes_to_gb("bytes").alias("total_bytes_inserted_gb")
    )


def w_streams_summary(streams: DataFrame) -> DataFrame:
    return scan_streams_inventory(streams).agg(
        F.count(F.lit(1)).alias("total_streams"), F.count_if("stale").alias("stale_streams")
    )


def w_mv_refresh(refreshes: DataFrame, window: Lookback, limit: int = 20) -> DataFrame:
    duration_ms = F.unix_millis(F.col("end_time").cast("timestamp")) - F.unix_millis(F.col("start_time").cast("timestamp"))
    views = (
        refreshes.filter(window.ts("start_time"))
        .groupBy("view_name")
        .agg(
            F.count(F.lit(1)).alias("total_refreshes"),
            sum_double("credits_used").alias("total_credits"),
            sum_long(duration_ms).alias("ms"),
        )
    )
    return top_k(views, limit, "total_refreshes", "view_name").select(
        "view_name",
        "total_refreshes",
        "total_credits",
        F.round(F.col("ms") / 1000.0 / F.col("total_refreshes"), 6).alias("avg_duration_seconds"),
    )


def w_replication_usage(replication: DataFrame, window: Lookback) -> DataFrame:
    return (
        replication.filter(window.ts("start_time"))
        .groupBy("replication_group_name")
        .agg(
            sum_double("credits_used").alias("total_credits"),
            sum_long("bytes_transferred").alias("total_bytes_transferred"),
            F.count(F.lit(1)).alias("event_count"),
        )
    )


# ---- jobs --------------------------------------------------------------------


def _run_counts():
    """A run succeeded or it failed: a missing result state counts as failed."""
    ok = F.col("result_state") == "SUCCEEDED"
    return F.count(F.lit(1)).alias("total_runs"), count_where(ok).alias("succeeded")


def l_job_cube(job_runs: DataFrame, window: Lookback) -> DataFrame:
    """Runs per (day, job): job and daily measures are folds of it."""
    rows = job_runs.filter(window.ts("period_start_time"))
    return rows.groupBy(F.to_date("period_start_time").alias("day"), "job_id").agg(
        *_run_counts(),
        sum_long("execution_duration_seconds").alias("total_seconds"),
        F.count("execution_duration_seconds").alias("timed_runs"),
    )


def l_fold_jobs(cube: DataFrame) -> DataFrame:
    measures = ("total_runs", "succeeded", "total_seconds", "timed_runs")
    rollup = cube.groupBy("job_id").agg(*[sum_long(m).alias(m) for m in measures])
    average = F.when(F.col("timed_runs") > 0, F.col("total_seconds") / F.col("timed_runs"))
    return rollup.withColumns({"avg_seconds": average, "failed": F.col("total_runs") - F.col("succeeded")}).drop("timed_runs")


def l_days_of_jobs(cube: DataFrame) -> DataFrame:
    daily = cube.groupBy("day").agg(sum_long("total_runs").alias("total_runs"), sum_long("succeeded").alias("succeeded"))
    return daily.withColumn("day", day_of("day"))


def l_job_rollup(job_runs: DataFrame, window: Lookback) -> DataFrame:
    return l_fold_jobs(l_job_cube(job_runs, window))


def l_top_jobs(job_rollup: DataFrame, limit: int = 20) -> DataFrame:
    return top_k(job_rollup, limit, "total_runs", "job_id")


def l_job_runs(job_rollup: DataFrame, jobs: DataFrame, limit: int = 20) -> DataFrame:
    """``jobs`` is (job_id, name) of current jobs; a job without a name shows its id."""
    named = attach(l_top_jobs(job_rollup, limit), "job_id", jobs, "job_id", "name", "_name")
    return named.select(
        "job_id",
        F.coalesce("_name", "job_id").alias("job_name"),
        "total_runs",
        "succeeded",
        "failed",
        F.round(F.coalesce("avg_seconds", F.lit(0.0)), 6).alias("avg_duration_seconds"),
        seconds_to_hours("total_seconds").alias("total_hours"),
    )


def l_job_totals(job_rollup: DataFrame) -> DataFrame:
    """Totals over every job of the window, not over the ranked ones."""
    totals = job_rollup.agg(
        F.count("job_id").alias("distinct_jobs_run"),
        sum_long("total_runs").alias("total_runs"),
        sum_long("succeeded").alias("succeeded"),
        sum_long("total_seconds").alias("total_seconds"),
    )
    return totals.select(
        "distinct_jobs_run",
        "total_runs",
        seconds_to_hours("total_seconds").alias("total_run_hours"),
        F.round(safe_percent("succeeded", "total_runs"), 6).alias("success_rate_percent"),
    )


def l_daily_job_runs(job_runs: DataFrame, window: Lookback) -> DataFrame:
    daily = (
        job_runs.filter(window.ts("period_start_time"))
        .groupBy(F.to_date("period_start_time").alias("day"))
        .agg(*_run_counts())
    )
    return daily.withColumn("day", day_of("day"))


def l_task_types(payloads: DataFrame, job_rollup: DataFrame, limit: int | None = None) -> DataFrame:
    """Task kinds of all jobs that ran, or of the ``limit`` busiest; only then are their ids broadcast."""
    ran = job_rollup.select("job_id") if limit is None else F.broadcast(l_top_jobs(job_rollup, limit).select("job_id"))
    tasks = job_tasks_from_json(payloads.join(ran, "job_id", "left_semi"))
    return tasks.groupBy(friendly_task_type("task_type").alias("task_type")).agg(F.count(F.lit(1)).alias("count"))
