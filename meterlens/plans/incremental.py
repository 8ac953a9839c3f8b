"""Rollups kept by day: a report reads only the days of the log that are new or may have had late rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions import Lookback
from meterlens.plans.settings import Stages
from meterlens.sources.staging import read_record, stage_path, write_record

#: How late rows of the usage views may appear.
LAG = timedelta(hours=3)


def _midnight(window: Lookback) -> date:
    as_of = window.as_of
    if not isinstance(as_of, datetime):
        as_of = datetime.fromisoformat(as_of if isinstance(as_of, str) else as_of.isoformat())
    if as_of != datetime.combine(as_of.date(), datetime.min.time()):
        raise ValueError(f"rollups by day need a window that ends at midnight, not at {as_of}")
    return as_of.date()


class DailyStages(Stages):
    """Stages whose rollups with a ``day`` column live on from report to report, one partition for each day.

    The record of a rollup holds the days it covers, from ``first`` until ``as_of``.  A later report computes the days
    from ``as_of - lag`` on, where rows may have come in since, and replaces their partitions; one that begins
    earlier, or whose rollup has other columns, computes all days.  The record is written when the partitions are in
    place, so after a killed write the same days are computed again.  Days without rows keep no partition; rows that
    come later than ``lag`` are not seen, and a log that loses rows needs a new folder.  Reports over one folder run
    one after the other.
    """

    def __init__(self, stage_dir: str, lag: timedelta = LAG, files_per_day: int = 1):
        super().__init__(stage_dir)
        self.lag, self.files_per_day = lag, files_per_day

    def _missing(self, record: dict | None, schema: str, first: date, end: date) -> tuple[date, bool]:
        """(first day to compute, whether what is there is dropped)."""
        if record is None or record["schema"] != schema:
            return first, True
        have_first, have_end = date.fromisoformat(record["first"]), date.fromisoformat(record["as_of"])
        if first < have_first or first > have_end:
            return first, True
        settled = (datetime.combine(have_end, datetime.min.time()) - self.lag).date()
        return max(first, min(settled, end)), False

    def days(self, name: str, build: Callable[[Lookback], DataFrame], window: Lookback) -> DataFrame:
        end = _midnight(window)
        first = end - timedelta(days=window.days)
        whole = build(window)
        spark, path, schema = whole.sparkSession, stage_path(self.stage_dir, name), whole.schema
        record = read_record(spark, path)
        since, anew = self._missing(record, schema.json(), first, end)
        in_days = F.col("day").between(F.lit(since.isoformat()), F.lit((end - timedelta(days=1)).isoformat()))
        if since < end or anew:
            rows = build(Lookback(end.isoformat(), (end - since).days)).filter(in_days)
            # a day's rows are dealt out before they are written, so that not every task writes to every day
            others = [c for c in rows.columns if c != "day"]
            dealt = rows.repartition("day", F.pmod(F.xxhash64(*others), F.lit(self.files_per_day)))
            mode = "static" if anew else "dynamic"
            dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("day").parquet(path)
            covered = (first, end) if anew else (date.fromisoformat(record["first"]), max(end, date.fromisoformat(record["as_of"])))
            write_record(spark, path, {"schema": schema.json(), "first": covered[0].isoformat(), "as_of": covered[1].isoformat()})
        days = F.col("day").between(F.lit(first.isoformat()), F.lit((end - timedelta(days=1)).isoformat()))
        return spark.read.schema(schema).parquet(path).filter(days).select(*schema.names)
