"""Guarded ratios, unit conversion and aggregate shorthands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlens.functions._cols import ColumnLike, col

BYTES_PER_GB = 1024.0**3
MS_PER_SECOND = 1000.0
SECONDS_PER_HOUR = 3600.0
GB_PER_TB = 1024.0
EXACT = "decimal(38,12)"


def safe_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """``a / b``, 0 when ``b`` is not positive or NULL."""
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(0.0))


def safe_percent(a: ColumnLike, b: ColumnLike) -> Column:
    return F.when(col(b) > 0, col(a) / col(b) * 100.0).otherwise(F.lit(0.0))


def bytes_to_gb(c: ColumnLike) -> Column:
    return col(c) / F.lit(BYTES_PER_GB)


def ms_to_seconds(c: ColumnLike) -> Column:
    return col(c) / F.lit(MS_PER_SECOND)


def seconds_to_hours(c: ColumnLike) -> Column:
    return col(c) / F.lit(SECONDS_PER_HOUR)


def per_tb_to_per_gb(c: ColumnLike) -> Column:
    return col(c) / F.lit(GB_PER_TB)


def sum_long(c: ColumnLike) -> Column:
    """Integer sum where no input means 0."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast("long")


def exact(c: ColumnLike) -> Column:
    """An amount as a decimal: sums of these do not depend on the order of tasks.  Too large, NaN or infinite is an error."""
    return col(c).cast(EXACT)


def sum_exact(c: ColumnLike) -> Column:
    """Decimal sum for folds that are folded further, NULL without input."""
    return F.sum(exact(c))


def sum_double(c: ColumnLike, digits: int | None = 6) -> Column:
    """Sum of amounts where no input means 0: added as decimals, then cast and rounded once.

    A report that is re-run, or partitioned in another way, gives the same money.  ``digits=None`` leaves
    the sum as it is, for totals that are added up again.
    """
    total = F.coalesce(sum_exact(c), F.lit(0)).cast("double")
    return total if digits is None else F.round(total, digits)


def count_where(condition: Column) -> Column:
    """Rows where the condition is true; false and NULL count nothing."""
    return F.count_if(condition)
