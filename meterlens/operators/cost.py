"""Cost: billed amounts, credit prices, and usage joined to time-valid list prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import (
    Lookback,
    bucket_people,
    day_of,
    display_name,
    month_of,
    per_tb_to_per_gb,
    safe_ratio,
    sum_double,
    sum_exact,
)
from meterlens.operators.lookup import attach, fits_broadcast
from meterlens.operators.ranking import top_k, top_n_with_other

# fixed values
COMPUTE_USAGE = "compute"
ESTIMATED_COMPUTE = "compute (estimated)"
ESTIMATED_STORAGE = "storage (estimated)"


# ---- warehouse: billed -------------------------------------------------------


def billed(billing: DataFrame, window: Lookback, account: str, currency: str = "USD") -> DataFrame:
    rows = billing.filter(
        (F.col("account_locator") == account) & (F.col("currency") == currency) & window.date("usage_date")
    )
    return rows.select("usage_date", "usage_type", F.col("usage_in_currency").alias("usd"))


def w_daily_cost(bill: DataFrame) -> DataFrame:
    daily = bill.groupBy("usage_date").agg(sum_double("usd").alias("usd"))
    return daily.select(day_of("usage_date").alias("day"), "usd")


def w_cost_by_type(bill: DataFrame) -> DataFrame:
    return bill.groupBy("usage_type").agg(sum_double("usd").alias("usd"))


def w_monthly_bill(bill: DataFrame) -> DataFrame:
    """USD per month and usage type; negative adjustments stay as billed."""
    monthly = bill.groupBy(F.trunc("usage_date", "month").alias("month"), "usage_type").agg(sum_double("usd").alias("usd"))
    return monthly.withColumn("month", month_of("month"))


def w_rate_per_credit(bill: DataFrame, total_credits: DataFrame) -> DataFrame:
    """One row: billed compute USD per credit, 0 without credits."""
    compute = sum_double(F.when(F.col("usage_type") == COMPUTE_USAGE, F.col("usd")), None)
    return bill.agg(compute.alias("compute_usd")).select(
        F.round(safe_ratio("compute_usd", total_credits.scalar()), 9).alias("usd_per_credit")
    )


# ---- warehouse: derived from credits -----------------------------------------

Rate = DataFrame | float


def _rate(rate: Rate) -> Column:
    """A price per credit: a number, or a one-row frame read as a scalar sub-query."""
    return rate.scalar() if isinstance(rate, DataFrame) else F.lit(float(rate))


def w_cost_by_warehouse(credits_by_warehouse: DataFrame, rate: Rate) -> DataFrame:
    return credits_by_warehouse.select(
        "warehouse_name", F.round(F.col("total_credits") * _rate(rate), 6).alias("usd")
    )


def w_user_cost(attribution: DataFrame, rate: Rate, window: Lookback, domain: str, label: str) -> DataFrame:
    """Cost of every user, employees in one bucket, before any ranking."""
    credits = (
        attribution.filter(window.ts("start_time"))
        .groupBy(bucket_people("user_name", domain, label).alias("user_name"))
        .agg(sum_double("credits_attributed_compute").alias("credits"))
    )
    return credits.select("user_name", F.round(F.col("credits") * _rate(rate), 6).alias("usd"))


def w_top_users_by_cost(user_cost: DataFrame, limit: int = 10) -> DataFrame:
    return top_k(user_cost, limit, "usd", "user_name")


def w_cost_by_user(user_cost: DataFrame, limit: int = 10) -> DataFrame:
    """Top users and one ``Other`` row."""
    return top_n_with_other(user_cost, "user_name", "usd", limit)


def wasted_compute_cost(exec_stats: DataFrame, credits_by_warehouse: DataFrame, rate: Rate) -> DataFrame:
    """One row: failed time priced at the warehouse's own credits per second of query time.

    All warehouses count, not just the ranked ones.
    """
    joined = exec_stats.filter(F.col("failed_count") > 0).join(
        credits_by_warehouse.select("warehouse_name", "total_credits"), "warehouse_name", "left"
    )
    # both times are in ms, so their ratio needs no conversion
    lost_credits = F.col("failed_exec_ms") * safe_ratio(F.coalesce("total_credits", F.lit(0.0)), "total_exec_ms")
    return joined.agg(sum_double(lost_credits, None).alias("lost")).select(
        F.round(F.col("lost") * _rate(rate), 6).alias("wasted_compute_cost_usd")
    )


# ---- warehouse: estimate and basis -------------------------------------------


def w_estimated_cost(
    total_credits: DataFrame, storage_summary: DataFrame, credit_price: float = 0.0, storage_price_per_tb: float = 0.0
) -> DataFrame:
    """Compute and storage cost from list prices; only positive amounts are listed."""
    compute = total_credits.select(
        F.lit(ESTIMATED_COMPUTE).alias("usage_type"), F.round(F.col("total_credits") * credit_price, 6).alias("usd")
    )
    storage = storage_summary.select(
        F.lit(ESTIMATED_STORAGE).alias("usage_type"),
        F.round(F.col("total_active_gb") * per_tb_to_per_gb(F.lit(float(storage_price_per_tb))), 6).alias("usd"),
    )
    return compute.unionByName(storage).filter(F.col("usd") > 0)


def w_estimated_daily_cost(daily_credits: DataFrame, credit_price: float) -> DataFrame:
    return daily_credits.select("day", F.round(F.col("credits") * credit_price, 6).alias("usd"))


def w_cost_basis(
    bill: DataFrame | None,
    total_credits: DataFrame | None = None,
    storage_summary: DataFrame | None = None,
    credit_price: float | None = None,
    storage_price_per_tb: float | None = None,
) -> DataFrame | None:
    """Total cost and its basis: billed, else estimated from prices, else ``None``.

    The choice follows which sources exist and is made while the plan is built.
    """
    if bill is not None:
        return bill.agg(sum_double("usd").alias("total_usd")).select(F.lit(False).alias("is_estimate"), "total_usd")
    if credit_price is None and storage_price_per_tb is None:
        return None
    parts = w_estimated_cost(total_credits, storage_summary, credit_price or 0.0, storage_price_per_tb or 0.0)
    return parts.agg(sum_double("usd").alias("total_usd")).select(F.lit(True).alias("is_estimate"), "total_usd")


# ---- lakehouse: priced usage -------------------------------------------------


def _at_list_price(usage: DataFrame, list_prices: DataFrame, extra_keys: Sequence[str]) -> DataFrame:
    """Usage aliased ``u`` with the price ``p`` in force when it started; usage without a price drops out."""
    u, p = usage.alias("u"), list_prices.alias("p")
    start, end, at = F.col("p.price_start_time"), F.col("p.price_end_time"), F.col("u.usage_start_time")
    condition = (at >= start) & (end.isNull() | (at < end))
    for key in ("sku_name", *extra_keys):
        condition = condition & (F.col(f"u.{key}") == F.col(f"p.{key}"))
    return u.join(p, condition)


def _at_price_of_day(usage: DataFrame, list_prices: DataFrame, window: Lookback, extra_keys: Sequence[str]) -> DataFrame:
    """As :func:`_at_list_price`, by (SKU, day).

    Days before the window count as the day before it and later ones as the day after, on both sides, so prices
    without an end and usage that started outside of its day's window are matched as well, and an interval has at
    most as many rows as the window has days, and two.  The interval itself still decides.
    """
    first, last = (F.lit(day.isoformat()).cast("date") for day in window.day_span())
    before, after = F.date_sub(first, 1), F.date_add(last, 1)

    def day(at: str) -> Column:
        return F.least(F.greatest(F.to_date(at), before), after)

    days = F.sequence(day("price_start_time"), F.when(F.col("price_end_time").isNull(), after).otherwise(day("price_end_time")))
    real = F.col("price_end_time").isNull() | (F.col("price_end_time") > F.col("price_start_time"))
    expanded = list_prices.filter(real).withColumn("_day", F.explode(days))
    return _at_list_price(usage.withColumn("_day", day("usage_start_time")), expanded, (*extra_keys, "_day"))


def priced_usage(usage: DataFrame, list_prices: DataFrame, window: Lookback, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Usage, row by row, at the list price in force when it started.

    A price list under Spark's broadcast threshold goes to every task: an equi join on the SKU with the validity
    interval as residual condition, and usage stays where it is.  A larger one is expanded to the days that each
    price holds, and both sides meet by (SKU, day), so that a hot SKU is spread over the days of the window.
    Sums do not need the rows: see :func:`l_cost_rollup`.  ``extra_keys`` (cloud, currency ...) must exist on both
    sides.
    """
    rows = usage.filter(window.date("usage_date"))
    small = fits_broadcast(list_prices)
    priced = _at_list_price(rows, list_prices, extra_keys) if small else _at_price_of_day(rows, list_prices, window, extra_keys)
    return priced.select(
        "u.usage_date",
        "u.sku_name",
        F.col("u.billing_origin_product").alias("product"),
        F.col("u.identity_metadata.run_as").alias("run_as"),
        F.col("u.usage_quantity").alias("dbu_quantity"),
        (F.col("u.usage_quantity") * F.col("p.pricing.default")).alias("usd"),
    )


COST_KEYS = ("usage_date", "sku_name", "product", "run_as")


def l_cost_rollup(
    usage: DataFrame, list_prices: DataFrame, window: Lookback, *keys: str, extra_keys: Sequence[str] = ()
) -> DataFrame:
    """Cost and quantity per ``keys`` (by default the daily grain that all cost tables fold further).

    Quantity is linear in the price, so usage is folded to its SKU and start time first: the log is read once,
    with the columns of ``keys`` only, and combined on the map side however hot a SKU is; the pricing join
    meets one row per start time and key.
    """
    keys = keys or COST_KEYS
    columns = {"product": F.col("billing_origin_product"), "run_as": F.col("identity_metadata.run_as")}
    grain = dict.fromkeys((*keys, "sku_name", "usage_start_time", *extra_keys))
    rows = usage.filter(window.date("usage_date")).select(*[columns.get(k, F.col(k)).alias(k) for k in grain], "usage_quantity")
    folded = rows.groupBy(*grain).agg(sum_exact("usage_quantity").alias("dbu_quantity"))
    usd = F.col("u.dbu_quantity").cast("double") * F.col("p.pricing.default")
    priced = _at_list_price(folded, list_prices, extra_keys).select(*[f"u.{k}" for k in keys], usd.alias("usd"), "u.dbu_quantity")
    return priced.groupBy(*keys).agg(sum_exact("usd").alias("usd"), sum_exact("dbu_quantity").alias("dbu_quantity"))


def l_daily_cost(priced: DataFrame) -> DataFrame:
    daily = priced.groupBy("usage_date").agg(sum_double("usd").alias("usd"))
    return daily.select(day_of("usage_date").alias("day"), "usd")


def l_cost_by_sku(priced: DataFrame) -> DataFrame:
    return priced.groupBy("sku_name").agg(
        sum_double("usd").alias("usd"), sum_double("dbu_quantity").alias("dbu_quantity")
    )


def l_daily_cost_by_product(priced: DataFrame) -> DataFrame:
    daily = priced.groupBy("usage_date", "product").agg(sum_double("usd").alias("usd"))
    return daily.select(day_of("usage_date").alias("day"), "product", "usd")


def l_user_cost(priced: DataFrame, principals: DataFrame, domain: str, label: str) -> DataFrame:
    """Cost of every displayed identity; unattributed usage is left out, so it sums below the total."""
    per_identity = priced.filter(F.col("run_as").isNotNull()).groupBy("run_as").agg(sum_exact("usd").alias("usd"))
    named = attach(per_identity, "run_as", principals, "id", "name", "_name")
    return named.groupBy(display_name("run_as", "_name", domain, label).alias("actor")).agg(sum_double("usd").alias("usd"))


def l_top_users_by_cost(user_cost: DataFrame, limit: int = 10) -> DataFrame:
    return top_k(user_cost, limit, "usd", "actor")


def l_cost_by_user(user_cost: DataFrame, limit: int = 10) -> DataFrame:
    return top_n_with_other(user_cost, "actor", "usd", limit)


def l_monthly_cost_by_sku(priced: DataFrame) -> DataFrame:
    monthly = priced.groupBy(F.trunc("usage_date", "month").alias("month"), "sku_name").agg(sum_double("usd").alias("usd"))
    return monthly.select(month_of("month").alias("month"), F.col("sku_name").alias("sku"), "usd")


# ---- lakehouse: billed export ------------------------------------------------


def l_real_billed_total(billable: DataFrame, daily_cost: DataFrame) -> DataFrame:
    """One row: billed dollars over the days of the list-price cost, NULL unless the export reaches back to its first day.

    The end of the export is not checked; ``last_covered_day`` shows it.
    """
    span = daily_cost.agg(F.struct(F.min("day").alias("first"), F.max("day").alias("last"))).scalar()
    rows = billable.select(day_of("usage_date").alias("day"), "dollars").withColumn("_span", span)
    totals = rows.agg(
        F.min("day").alias("first_covered_day"),
        F.max("day").alias("last_covered_day"),
        F.max("_span").alias("_span"),
        sum_double(F.when(F.col("day").between(F.col("_span.first"), F.col("_span.last")), F.col("dollars"))).alias("usd"),
    )
    return totals.select(
        F.when(F.col("first_covered_day") <= F.col("_span.first"), F.col("usd")).alias("real_total_usd"),
        "last_covered_day",
    )


def l_discount(real_billed: DataFrame, daily_cost: DataFrame) -> DataFrame:
    """One row: billed over list price, and the discount in percent; NULL without a billed total."""
    listed = daily_cost.agg(sum_exact("usd").cast("double")).scalar()
    ratio = real_billed.withColumn("_ratio", F.col("real_total_usd") / F.nullif(listed, F.lit(0.0)))
    return ratio.select(
        F.round("_ratio", 6).alias("real_billed_discount_ratio"),
        F.round((F.lit(1.0) - F.col("_ratio")) * 100.0, 6).alias("discount_percent"),
    )
