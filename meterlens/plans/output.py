"""Reports on disk: every measure as a staged table, the platform summary also as JSON."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from meterlens.sources.staging import stage_read_optional, stage_write, write_summary_json

SUMMARY = "platform_summary"


def summary_path(out_dir: str) -> str:
    return f"{out_dir.rstrip('/')}/{SUMMARY}.json"


def write_report(report: Mapping[str, DataFrame | None], out_dir: str) -> list[str]:
    """Write the measures that exist and return their names."""
    written = [name for name, df in report.items() if df is not None]
    for name in written:
        stage_write(report[name], out_dir, name)
    if SUMMARY in written:
        write_summary_json(stage_read_optional(report[SUMMARY].sparkSession, out_dir, SUMMARY), summary_path(out_dir))
    return written


def read_report(spark: SparkSession, out_dir: str, names: Iterable[str]) -> dict[str, DataFrame | None]:
    """A written report without any of its sources; ``None`` for a measure it did not have."""
    return {name: stage_read_optional(spark, out_dir, name) for name in names}
