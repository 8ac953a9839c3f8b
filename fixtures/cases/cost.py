"""Cost on both sides."""

from fixtures.cases.access import LIVE, TS
from fixtures.cases.activity import BUCKET, DAILY_CREDITS, EXEC, MET, TOP_WH_CREDITS, TOTAL_CREDITS, WH, WH_CREDITS, exec_stats
from fixtures.cases.registry import E_SINCE, E_UNTIL, EV, GB, L_SINCE, L_UNTIL, LI, O_SINCE, O_UNTIL, OR, case, day, folded
from fixtures.cases.users import DISPLAY, PRINCIPALS
from fixtures.views import ACCOUNT, CURRENCY, DOMAIN, EMPLOYEES
from meterlens.operators import activity, cost as c, ranking, storage
from meterlens.sources import principal_names

BL = "w_billing"
CREDIT_PRICE, TB_PRICE = 3.0, 23.0
BILLED = (
    f"SELECT usage_date, usage_type, usage_in_currency AS usd FROM {BL} WHERE account_locator = '{ACCOUNT}' "
    f"AND currency = '{CURRENCY}' AND usage_date >= CAST({O_SINCE} AS DATE) AND usage_date < CAST({O_UNTIL} AS DATE)"
)
BILL = {"bill": BILLED}


def bill(t):
    return c.billed(t[BL], OR, ACCOUNT, CURRENCY)


def total_credits(t):
    return activity.w_total_credits(t[MET], EV)


def rate(t):
    return c.w_rate_per_credit(bill(t), total_credits(t))


DAILY = f"SELECT {day('usage_date')} AS day, round(sum(usd), 6) AS usd FROM bill GROUP BY 1"
BY_TYPE = "SELECT usage_type, round(sum(usd), 6) AS usd FROM bill GROUP BY 1"
MONTHLY = "SELECT strftime(usage_date, '%Y-%m') AS month, usage_type, round(sum(usd), 6) AS usd FROM bill GROUP BY 1, 2"
RATE = (
    "SELECT round(sum(CASE WHEN usage_type = 'compute' THEN usd ELSE 0 END) / (SELECT total_credits FROM credits), 9) "
    "AS usd_per_credit FROM bill"
)
RATE_CTES = BILL | {"credits": TOTAL_CREDITS, "rate": RATE}
case("w_daily_cost", lambda t: c.w_daily_cost(bill(t)), DAILY, BL, ctes=BILL)
case("w_cost_by_type", lambda t: c.w_cost_by_type(bill(t)), BY_TYPE, BL, ctes=BILL)
case("w_monthly_bill", lambda t: c.w_monthly_bill(bill(t)), MONTHLY, BL, ctes=BILL)
case("w_rate_per_credit", rate, "SELECT * FROM rate", BL, MET, ctes=RATE_CTES)
case(
    "cumulative_cost",
    lambda t: ranking.cumulative_cost(c.w_daily_cost(bill(t))),
    "SELECT day, round(sum(usd) OVER (ORDER BY day), 6) AS usd FROM daily",
    BL,
    ctes=BILL | {"daily": DAILY},
)
case(
    "top_n_with_other",
    lambda t: ranking.top_n_with_other(c.w_cost_by_type(bill(t)), "usage_type", "usd", 5),
    folded("by_type", "usage_type", "usd", 5),
    BL,
    ctes=BILL | {"by_type": BY_TYPE},
)
MONTHS = OR.months()
GRID_ITEMS = (
    "SELECT usage_type, lower(usage_type) LIKE '%adj%' AS adj, sum(usd) AS tot, "
    "row_number() OVER (PARTITION BY lower(usage_type) LIKE '%adj%' ORDER BY sum(usd) DESC, usage_type) AS rn FROM m GROUP BY 1, 2"
)


def _grid(item: str, months, source: str = "lab") -> str:
    cells = ", ".join(
        f"round(coalesce(sum(CASE WHEN month = '{m}' THEN usd END), 0), 6) AS \"{m}\"" for m in months
    )
    return (
        f"SELECT line_item, adj AS is_adjustment, round(sum(usd), 6) AS total, {cells} FROM {source} GROUP BY 1, 2 "
        f"UNION ALL SELECT 'TOTAL', FALSE, round(sum(usd), 6), {cells} FROM {source}"
    )


case(
    "monthly_bill_pivot",
    lambda t: ranking.monthly_bill_pivot(c.w_monthly_bill(bill(t)), MONTHS, "usage_type"),
    _grid("usage_type", MONTHS),
    BL,
    ctes=BILL
    | {
        "m": MONTHLY,
        "items": GRID_ITEMS,
        "lab": "SELECT CASE WHEN i.adj OR i.rn <= 8 THEN m.usage_type ELSE 'Other' END AS line_item, i.adj, m.month, m.usd "
        "FROM m JOIN items i ON m.usage_type = i.usage_type",
    },
)
case(
    "w_cost_by_warehouse",
    lambda t: c.w_cost_by_warehouse(activity.w_credits_by_warehouse(t[MET], EV), rate(t)),
    "SELECT warehouse_name, round(total_credits * (SELECT usd_per_credit FROM rate), 6) AS usd FROM wc",
    BL,
    MET,
    ctes=RATE_CTES | {"wc": TOP_WH_CREDITS},
)
USER_COST = (
    f"SELECT user_name, round(credits * (SELECT usd_per_credit FROM rate), 6) AS usd FROM ("
    f"SELECT {BUCKET.format('user_name')} AS user_name, round(sum(credits_attributed_compute), 6) AS credits FROM w_attribution "
    f"WHERE start_time >= {E_SINCE} AND start_time < {E_UNTIL} GROUP BY 1)"
)
case(
    "w_cost_by_user",
    lambda t: c.w_cost_by_user(c.w_user_cost(t["w_attribution"], rate(t), EV, DOMAIN, EMPLOYEES)),
    folded("uc", "user_name", "usd", 10),
    BL,
    MET,
    "w_attribution",
    ctes=RATE_CTES | {"uc": USER_COST},
)
case(
    "w_top_users_by_cost",
    lambda t: c.w_top_users_by_cost(c.w_user_cost(t["w_attribution"], rate(t), EV, DOMAIN, EMPLOYEES)),
    "SELECT user_name, usd FROM uc ORDER BY usd DESC, user_name LIMIT 10",
    BL,
    MET,
    "w_attribution",
    ctes=RATE_CTES | {"uc": USER_COST},
)
STORAGE_GB = f"SELECT CAST(sum(bytes) AS BIGINT) / {GB}::DOUBLE AS gb FROM live"
case(
    "w_estimated_cost",
    lambda t: c.w_estimated_cost(total_credits(t), storage.w_storage_summary(t[TS]), CREDIT_PRICE, TB_PRICE),
    f"SELECT 'compute (estimated)' AS usage_type, round(total_credits * {CREDIT_PRICE}::DOUBLE, 6) AS usd FROM credits UNION ALL "
    f"SELECT 'storage (estimated)', round(gb * ({TB_PRICE}::DOUBLE / 1024.0::DOUBLE), 6) FROM gb",
    MET,
    TS,
    ctes={"credits": TOTAL_CREDITS, "live": LIVE, "gb": STORAGE_GB},
)
case(
    "w_estimated_daily_cost",
    lambda t: c.w_estimated_daily_cost(activity.w_daily_credits(t[MET], EV), CREDIT_PRICE),
    f"SELECT day, round(credits * {CREDIT_PRICE}::DOUBLE, 6) AS usd FROM d",
    MET,
    ctes={"d": DAILY_CREDITS},
)
case(
    "w_cost_basis",
    lambda t: c.w_cost_basis(bill(t)),
    "SELECT FALSE AS is_estimate, round(sum(usd), 6) AS total_usd FROM bill",
    BL,
    ctes=BILL,
)
WASTED = (
    "SELECT round(sum(failed_exec_ms * CASE WHEN total_exec_ms > 0 THEN coalesce(total_credits, 0) / total_exec_ms ELSE 0 END) "
    "* (SELECT usd_per_credit FROM rate), 6) AS wasted_compute_cost_usd FROM ex LEFT JOIN wc USING (warehouse_name) WHERE failed_count > 0"
)
case(
    "wasted_compute_cost",
    lambda t: c.wasted_compute_cost(exec_stats(t), activity.w_credits_by_warehouse(t[MET], EV, limit=None), rate(t)),
    WASTED,
    WH,
    BL,
    MET,
    ctes=RATE_CTES | {"ex": EXEC, "wc": WH_CREDITS},
)

# ---- lakehouse
PRICED = (
    "SELECT u.usage_date, u.sku_name, u.billing_origin_product AS product, u.run_as, u.usage_quantity AS dbu_quantity, "
    "u.usage_quantity * p.price AS usd FROM l_usage u JOIN l_list_prices p ON u.sku_name = p.sku_name "
    "AND u.usage_start_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_start_time < p.price_end_time) "
    f"WHERE u.usage_date >= CAST({L_SINCE} AS DATE) AND u.usage_date < CAST({L_UNTIL} AS DATE)"
)
PV = ("l_usage", "l_list_prices")
PR = {"priced": PRICED}


def priced(t, *keys):
    return c.l_cost_rollup(t["l_usage"], t["l_list_prices"], LI, *keys)


L_DAILY = f"SELECT {day('usage_date')} AS day, round(sum(usd), 6) AS usd FROM priced GROUP BY 1"
BY_SKU = "SELECT sku_name, round(sum(usd), 6) AS usd, round(sum(dbu_quantity), 6) AS dbu_quantity FROM priced GROUP BY 1"
case("priced_usage", lambda t: c.priced_usage(t["l_usage"], t["l_list_prices"], LI), "SELECT * FROM priced", *PV, ctes=PR)
case("l_daily_cost", lambda t: c.l_daily_cost(priced(t, "usage_date")), L_DAILY, *PV, ctes=PR)
case("l_cost_by_sku", lambda t: c.l_cost_by_sku(priced(t, "sku_name")), BY_SKU, *PV, ctes=PR)
case(
    "l_daily_cost_by_product",
    lambda t: c.l_daily_cost_by_product(priced(t, "usage_date", "product")),
    f"SELECT {day('usage_date')} AS day, product, round(sum(usd), 6) AS usd FROM priced GROUP BY 1, 2",
    *PV,
    ctes=PR,
)
L_USER = (
    f"SELECT {DISPLAY.format('x.run_as')} AS actor, round(sum(usd), 6) AS usd FROM priced x "
    "LEFT JOIN principals p ON x.run_as = p.id WHERE run_as IS NOT NULL GROUP BY 1"
)
case(
    "l_cost_by_user",
    lambda t: c.l_cost_by_user(c.l_user_cost(priced(t, "run_as"), principal_names(t["l_principals"]), DOMAIN, EMPLOYEES)),
    folded("uc", "actor", "usd", 10),
    *PV,
    "l_principals",
    ctes=PR | {"principals": PRINCIPALS, "uc": L_USER},
)
case(
    "l_top_users_by_cost",
    lambda t: c.l_top_users_by_cost(c.l_user_cost(priced(t, "run_as"), principal_names(t["l_principals"]), DOMAIN, EMPLOYEES)),
    "SELECT actor, usd FROM uc ORDER BY usd DESC, actor LIMIT 10",
    *PV,
    "l_principals",
    ctes=PR | {"principals": PRINCIPALS, "uc": L_USER},
)
L_MONTHLY = "SELECT strftime(usage_date, '%Y-%m') AS month, sku_name AS sku, round(sum(usd), 6) AS usd FROM priced GROUP BY 1, 2"
case("l_monthly_cost_by_sku", lambda t: c.l_monthly_cost_by_sku(priced(t, "usage_date", "sku_name")), L_MONTHLY, *PV, ctes=PR)
case(
    "l_monthly_bill_pivot",
    lambda t: ranking.monthly_bill_pivot(c.l_monthly_cost_by_sku(priced(t, "usage_date", "sku_name")), LI.months(), "sku", adjustments_apart=False),
    _grid("sku", LI.months()),
    *PV,
    ctes=PR
    | {
        "m": L_MONTHLY,
        "items": "SELECT sku, row_number() OVER (ORDER BY sum(usd) DESC, sku) AS rn FROM m GROUP BY 1",
        "lab": "SELECT CASE WHEN i.rn <= 8 THEN m.sku ELSE 'Other' END AS line_item, FALSE AS adj, m.month, m.usd "
        "FROM m JOIN items i ON m.sku = i.sku",
    },
)
# the billed export: daily list usage at 0.8, as text
BILLABLE = (
    "SELECT usage_date, round(sum(usage_quantity), 6) AS dbus, round(sum(usage_quantity) * 0.8::DOUBLE, 6) AS dollars FROM l_usage GROUP BY 1"
)
REAL = (
    f"SELECT CASE WHEN min({day('usage_date')}) <= (SELECT min(day) FROM daily) THEN round(sum(CASE WHEN {day('usage_date')} "
    "BETWEEN (SELECT min(day) FROM daily) AND (SELECT max(day) FROM daily) THEN dollars END), 6) END AS real_total_usd, "
    f"max({day('usage_date')}) AS last_covered_day FROM billable"
)
REAL_CTES = PR | {"billable": BILLABLE, "daily": L_DAILY}
