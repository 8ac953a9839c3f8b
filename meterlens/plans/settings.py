"""Settings of a report and the staging of the rollups that its measures share."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meterlens.functions import Lookback
from meterlens.sources.staging import read_record, stage_path, stage_read, stage_write, stage_write_bucketed

Inputs = Mapping[str, DataFrame | None]


@dataclass(frozen=True)
class ReportSettings:
    """What the caller decides: window, employer, account, prices.

    ``windows`` overrides the window of single tables (billing often reaches further back).
    ``watched_login`` names the channel and the client type whose shares of all logins are reported.
    """

    window: Lookback
    domain: str
    employee_label: str = "Employees"
    account: str = ""
    currency: str = "USD"
    credit_price: float | None = None
    storage_price_per_tb: float | None = None
    generated_at: str = ""
    watched_login: tuple[str, str] | None = None
    windows: Mapping[str, Lookback] = field(default_factory=dict)

    def window_of(self, table: str) -> Lookback:
        return self.windows.get(table, self.window)


def window_text(window: Lookback | None) -> str | None:
    """How a stage's record states its window."""
    return None if window is None else f"{window.days} days before {window.as_of}"


class StageMismatch(ValueError):
    """A staged rollup was made over another window, or with other columns, than the report asks for."""


class Stages:
    """Write each shared rollup as Parquet and read it back.

    Several outputs then start from the small table instead of each rescanning the log, and the
    lineage ends at a file that outlives any executor.  With ``resume`` a rollup that is already
    staged is read instead of computed, so that a report can be built anew, with another domain or
    price say, after its logs are gone.  One of another window or schema is refused, one whose write
    did not end is computed anew.
    """

    def __init__(self, stage_dir: str, resume: bool = False):
        self.stage_dir, self.resume = stage_dir, resume

    def __call__(self, name: str, df: DataFrame, window: Lookback | None = None) -> DataFrame:
        spark, stated = df.sparkSession, window_text(window)
        record = read_record(spark, stage_path(self.stage_dir, name)) if self.resume else None
        if record is None:
            stage_write(df, self.stage_dir, name, stated)
        elif record["window"] != stated:
            raise StageMismatch(f"{name} was staged over {record['window']}, not over {stated}")
        elif T.StructType.fromJson(json.loads(record["schema"])).simpleString() != df.schema.simpleString():
            raise StageMismatch(f"{name} was staged with other columns")
        return stage_read(spark, self.stage_dir, name, df.schema)

    def days(self, name: str, build: Callable[[Lookback], DataFrame], window: Lookback) -> DataFrame:
        """A rollup with a ``day`` column, made by ``build`` over a window."""
        return self(name, build(window), window)

    def keyed(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """The distinct rows of a table, which later aggregates and joins by ``key`` read without a shuffle.

        It is computed anew by every report: a bucketed table belongs to the catalog of its session.
        """
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return stage_write_bucketed(df, self.stage_dir, name, key, buckets)


class NoStages(Stages):
    """Nothing is staged: each rollup is planned into every measure that uses it."""

    def __init__(self) -> None:
        super().__init__("")

    def __call__(self, name: str, df: DataFrame, window: Lookback | None = None) -> DataFrame:
        return df

    def keyed(self, name: str, df: DataFrame, key: str) -> DataFrame:
        return df.distinct()


no_stage = NoStages()
Stage = Stages


def stage_to(stage_dir: str, resume: bool = False) -> Stages:
    return Stages(stage_dir, resume)
