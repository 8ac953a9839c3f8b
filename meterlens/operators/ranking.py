"""Ranking, folding and shaping of rolled-up rows.

Windows without partition keys run here only over rows whose number has a fixed bound (a top-N
head) or one row per calendar day; the full key set of a ranking is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.functions import exact, is_adjustment, sum_double, sum_exact
from meterlens.functions._cols import ColumnLike, col

OTHER = "Other"
TOTAL = "TOTAL"


def rank_order(measure: ColumnLike, *ties: str) -> list[Column]:
    """Largest measure first; equal measures by name, so that every run cuts at the same row."""
    return [col(measure).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]


def top_k(df: DataFrame, limit: int, measure: ColumnLike, *ties: str) -> DataFrame:
    return df.orderBy(*rank_order(measure, *ties)).limit(limit)


def kept_keys(totals: DataFrame, key: str, measure: str, n: int, keep_one_over: bool) -> DataFrame:
    """The keys that stay named: the top ``n``, or all of them when there are at most ``n + 1``.

    ``n + 2`` rows tell which case it is, so that is all the window ever sees.
    """
    head = top_k(totals, n + 2, measure, key)
    ranked = head.select(
        F.col(key),
        F.row_number().over(Window.orderBy(*rank_order(measure, key))).alias("_rank"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("_keys"),
    )
    named = F.col("_rank") <= n
    if keep_one_over:
        named = named | (F.col("_keys") <= n + 1)
    return ranked.filter(named).select(key)


def fold_others(
    rows: DataFrame, kept: DataFrame, key: str, value: str, dims: Sequence[str] = (), label: str = OTHER, digits: int = 6
) -> DataFrame:
    """Sum ``value`` per kept key (and ``dims``); every other key goes into ``label``.

    ``kept`` comes from :func:`kept_keys`: at most ``n + 2`` rows, hence the broadcast.
    """
    marks = kept.select(F.col(key).alias("_kept_key"), F.lit(True).alias("_kept"))
    marked = rows.join(F.broadcast(marks), F.col(key).eqNullSafe(F.col("_kept_key")), "left")
    named = F.coalesce(F.col("_kept"), F.lit(False))
    total = sum_double(value, digits) if dict(rows.dtypes)[value] == "double" else F.sum(value)
    return (
        marked.select(*dims, F.col(value), named.alias("_named"), F.when(named, F.col(key)).otherwise(label).alias(key))
        .groupBy(*dims, "_named", key)
        .agg(total.alias(value))
        .select(*dims, key, value)
    )


def top_n_with_other(
    totals: DataFrame, key: str, value: str, n: int, keep_one_over: bool = True, label: str = OTHER
) -> DataFrame:
    """Top ``n`` keys and one ``Other`` row for the rest; ``n + 1`` keys stay as they are."""
    return fold_others(totals, kept_keys(totals, key, value, n, keep_one_over), key, value, label=label)


def top_n_trend(
    rows: DataFrame, key: str, value: str, n: int, dims: Sequence[str], totals: DataFrame | None = None, measure: str | None = None
) -> DataFrame:
    """A series per top key and one for all others.  ``totals`` ranks the keys, by default their sum."""
    if totals is None:
        money = dict(rows.dtypes)[value] == "double"
        totals, measure = rows.groupBy(key).agg((sum_exact(value) if money else F.sum(value)).alias("_total")), "_total"
    return fold_others(rows, kept_keys(totals, key, measure, n, keep_one_over=False), key, value, dims)


def cumulative_cost(daily: DataFrame, day: str = "day", value: str = "usd", digits: int = 6) -> DataFrame:
    """Running total; the input has one row per calendar day, so the single ordered window stays short."""
    running = sum_exact(value).over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return daily.select(day, F.round(running.cast("double"), digits).alias(value))


def latest_snapshot(rows: DataFrame, key: str, date: str, value: str, digits: int = 6) -> DataFrame:
    """Per key, the sum of its rows on its own latest date."""
    per_date = rows.groupBy(key, date).agg(sum_exact(value).alias("_sum"))
    last = F.coalesce(F.max_by("_sum", date), F.lit(0)).cast("double")
    return per_date.groupBy(key).agg(F.max(date).alias(date), F.round(last, digits).alias(value))


def monthly_bill_pivot(
    bill: DataFrame,
    months: Sequence[str],
    item: str,
    top_n: int = 8,
    adjustments_apart: bool = True,
    month: str = "month",
    value: str = "usd",
    digits: int = 6,
) -> DataFrame:
    """Bill as a grid: one row per line item and a total row, one column per month and a row total.

    The ``top_n`` items keep their row, the rest fold into ``Other``; adjustments always keep
    their own row.  The month list comes from the report window, so no job runs to find it.
    """
    adjustment = is_adjustment(item) if adjustments_apart else F.lit(False)
    # a month outside the list has no column and is in no total either
    listed = F.when(F.col(month).isin(*months), F.col(value))
    lines = bill.select(F.col(item).alias("line_item"), adjustment.alias("is_adjustment"), month, exact(listed).alias(value))
    # adjustments rank last instead of being filtered out: a filter would be pushed below the bill's
    # own aggregate and the bill computed twice instead of its shuffle being shared
    totals = lines.groupBy("line_item", "is_adjustment").agg(F.sum(value).alias("_total"))
    ranking = [F.col("is_adjustment").asc(), *rank_order("_total", "line_item")]
    head = totals.orderBy(*ranking).limit(top_n).filter(~F.col("is_adjustment"))
    marks = head.select(F.col("line_item").alias("_kept_key"), F.lit(True).alias("_kept"))
    named = F.col("is_adjustment") | F.coalesce(F.col("_kept"), F.lit(False))
    labelled = lines.join(F.broadcast(marks), F.col("line_item").eqNullSafe(F.col("_kept_key")), "left").select(
        F.when(named, F.col("line_item")).otherwise(OTHER).alias("line_item"), "is_adjustment", named.alias("_named"), month, value
    )
    cells = [
        sum_double(F.when(F.col(month) == m, F.col(value)), digits).alias(m) for m in months
    ]
    keys = [F.col("line_item"), F.col("is_adjustment"), F.col("_named")]
    grid = labelled.groupingSets([keys, []], *keys).agg(
        F.grouping("line_item").alias("_is_total"), sum_double(value, digits).alias("total"), *cells
    )
    is_total = F.col("_is_total") == 1
    return grid.select(
        F.when(is_total, TOTAL).otherwise(F.col("line_item")).alias("line_item"),
        F.when(is_total, F.lit(False)).otherwise(F.col("is_adjustment")).alias("is_adjustment"),
        "total",
        *[f"`{m}`" for m in months],
    )


def densify_daily_series(rows: DataFrame, key: str, value: str, day: str = "day") -> DataFrame:
    """Every (day, key) pair of a daily series, 0 where it had no row.

    The days, one per calendar day of the window, are folded into an array that each key
    explodes; the keys stay distributed.
    """
    zero = F.lit(0).cast(dict(rows.dtypes)[value])
    days = rows.select(F.collect_set(day)).scalar()
    grid = rows.select(key).distinct().select(key, F.explode(days).alias(day))
    return grid.join(rows, [day, key], "left").select(day, key, F.coalesce(value, zero).alias(value))


def data_span(daily: DataFrame, fallback_days: int, day: str = "day") -> DataFrame:
    """First and last day present and the days they span; the configured window if there is no data."""
    ends = daily.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    span = F.datediff(F.to_date("last_day"), F.to_date("first_day")) + 1
    return ends.select("first_day", "last_day", F.coalesce(span, F.lit(fallback_days)).cast("int").alias("day_count"))


def merge_one_row(*rows: DataFrame) -> DataFrame:
    """One-row frames side by side.

    A union with one wide aggregate on top: each frame is its own stage of the same job, and no
    frame is joined to another.  A column of a frame without rows is NULL.
    """
    merged = rows[0]
    for row in rows[1:]:
        merged = merged.unionByName(row, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for r in rows for c in r.columns])
