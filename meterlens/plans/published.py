"""Platform summaries that reports leave for comparisons, looked up by platform, window and report time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlens.plans.comparison import comparison_report
from meterlens.sources.staging import SUCCESS, path_exists, read_summary_json, write_summary_json


def summary_key(platform: str, lookback_days: int, generated_at: str) -> str:
    """The name a summary is stored under; the digest keeps apart what the readable part does not."""
    digest = hashlib.sha256(repr((platform, lookback_days, generated_at)).encode()).hexdigest()[:12]
    return "-".join([re.sub(r"[^0-9A-Za-z]+", "-", f"{platform}-{lookback_days}d-{generated_at}").strip("-"), digest])


def published(spark: SparkSession, store: str, platform: str, lookback_days: int, generated_at: str) -> DataFrame | None:
    """The stored summary, ``None`` if it was never published or its write did not end."""
    path = f"{store.rstrip('/')}/{summary_key(platform, lookback_days, generated_at)}.json"
    return read_summary_json(spark, path) if path_exists(spark, f"{path}/{SUCCESS}") else None


def publish(summary: DataFrame, store: str, platform: str, lookback_days: int, generated_at: str) -> DataFrame:
    """Store a summary and return it as read back.  One of the same key is replaced."""
    path = f"{store.rstrip('/')}/{summary_key(platform, lookback_days, generated_at)}.json"
    write_summary_json(summary, path)
    return read_summary_json(summary.sparkSession, path)


def published_or(
    spark: SparkSession, store: str, platform: str, lookback_days: int, generated_at: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The stored summary; only where there is none, ``build`` computes it from the logs."""
    found = published(spark, store, platform, lookback_days, generated_at)
    return publish(build(), store, platform, lookback_days, generated_at) if found is None else found


def stored_comparison(spark: SparkSession, w_path: str, l_path: str) -> dict[str, DataFrame]:
    """All comparisons of the summaries that two reports have written; no log is read."""
    return comparison_report(read_summary_json(spark, w_path), read_summary_json(spark, l_path))
