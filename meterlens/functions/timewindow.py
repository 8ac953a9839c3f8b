"""Time filters and calendar keys.

Cut-offs are string literals: Catalyst casts the literal to the type of the
column (date, timestamp or timestamp_ntz) and folds it, so the predicate stays
a plain column comparison that reaches the Parquet scan or prunes partitions.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlens.functions._cols import ColumnLike, col


def _as_datetime(as_of: str | date | datetime) -> datetime:
    if isinstance(as_of, datetime):
        return as_of
    return datetime.fromisoformat(as_of if isinstance(as_of, str) else as_of.isoformat())


def _last_day(as_of: str | date | datetime) -> date:
    """The last day with a moment before ``as_of``: the day before, if that is midnight."""
    return (_as_datetime(as_of) - timedelta(microseconds=1)).date()


def lookback_ts(ts: ColumnLike, as_of: str | date | datetime, days: int) -> Column:
    """Rolling window: ``as_of - days <= ts < as_of``."""
    end = _as_datetime(as_of)
    return (col(ts) >= F.lit((end - timedelta(days=days)).isoformat(sep=" "))) & (col(ts) < F.lit(end.isoformat(sep=" ")))


def lookback_date(day: ColumnLike, as_of: str | date | datetime, days: int) -> Column:
    """Calendar window: ``date(as_of) - days <= day``, and the day begins before ``as_of``.

    At midnight the day of ``as_of`` is out, as for timestamps; later in the day it is in.
    """
    cutoff = _as_datetime(as_of).date() - timedelta(days=days)
    return (col(day) >= F.lit(cutoff.isoformat())) & (col(day) <= F.lit(_last_day(as_of).isoformat()))


def months_between(as_of: str | date | datetime, days: int) -> list[str]:
    """Every ``yyyy-MM`` that the lookback window touches, oldest first."""
    last = _last_day(as_of)
    first = _as_datetime(as_of).date() - timedelta(days=days)
    span = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in span]


def not_deleted(marker: ColumnLike, flag: bool = False) -> Column:
    """Live rows: a NULL deletion time, or a deletion flag that is false."""
    return ~col(marker) if flag else col(marker).isNull()


def positive_duration(duration: ColumnLike) -> Column:
    return col(duration) > 0


def day_of(ts: ColumnLike) -> Column:
    """``yyyy-MM-dd``.  Group by ``to_date`` and format afterwards: days are compact group keys."""
    return F.date_format(col(ts), "yyyy-MM-dd")


def month_of(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


class Lookback(NamedTuple):
    """The window of a report: everything in the ``days`` before ``as_of``, nothing from then on."""

    as_of: str | date | datetime
    days: int

    def ts(self, column: ColumnLike) -> Column:
        return lookback_ts(column, self.as_of, self.days)

    def date(self, column: ColumnLike) -> Column:
        return lookback_date(column, self.as_of, self.days)

    def day_span(self) -> tuple[date, date]:
        """First and last day with a moment in the window."""
        return _as_datetime(self.as_of).date() - timedelta(days=self.days), _last_day(self.as_of)

    def months(self) -> list[str]:
        return months_between(self.as_of, self.days)
