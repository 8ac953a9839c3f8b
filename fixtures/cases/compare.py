"""Headline rows, platform summaries, comparison."""

from pyspark.sql import functions as F

from fixtures.cases.access import LIVE, MANIFEST, TS
from fixtures.cases.activity import (
    ACTIVE_BY_TYPE,
    BY_USER,
    COMPUTE_CTES,
    COMPUTE_VIEWS,
    EXEC,
    L_OVERVIEW,
    LH,
    MET,
    TOTAL_CREDITS,
    TYPED_CTES,
    WH,
    WH_CREDITS,
    exec_stats,
)
from fixtures.cases.cost import ACCOUNT, BILL, BL, BY_SKU, CURRENCY, L_DAILY, PR, PV, RATE_CTES, REAL, REAL_CTES, STORAGE_GB, bill, priced, rate, total_credits
from fixtures.cases.inventory import CATALOGS, JOB_ROLL, JOB_TOTALS, JR, L_OBJECTS, OBJECTS, SIZED, TASKS, job_rollup, sizes
from fixtures.cases.registry import E_SINCE, EV, GB, LI, OR, case
from fixtures.cases.sources import billable
from fixtures.cases.users import DAILY_ACTIVE
from fixtures.views import DOMAIN
from meterlens.operators import activity, automation, cost, inventory, storage, users
from meterlens.plans import comparison, lakehouse, summary, warehouse
from meterlens.plans.published import published_or
from meterlens.plans.settings import stage_to
from meterlens.session import scratch_dir
from meterlens.sources import read_summary_json, user_types, write_summary_json

DAYS, GENERATED = 365, "2024-01-31T00:00:00Z"
L_DAYS = 360


def _w_summary(t):
    by_user = activity.w_daily_query_by_user(t[WH], EV)
    credits = activity.w_credits_by_warehouse(t[MET], EV, limit=None)
    return summary.w_platform_summary(
        exec_stats(t),
        users.w_daily_active_by_type(by_user, user_types(t["w_users"]), DOMAIN),
        storage.w_storage_summary(t[TS]),
        cost.w_cost_basis(bill(t)),
        cost.w_cost_by_warehouse(credits, rate(t)),
        inventory.w_object_inventory(t["w_objects"]),
        automation.w_task_rollup(t["w_task_history"], OR),
        DAYS,
        GENERATED,
    )


W_SUMMARY = f"""
SELECT 'warehouse' AS platform, {DAYS} AS lookback_days, '{GENERATED}' AS generated_at,
  (SELECT round(sum(usd), 6) FROM bill) AS total_cost_usd, FALSE AS cost_is_estimate,
  (SELECT round(sum(round(total_credits * (SELECT usd_per_credit FROM rate), 6)), 6) FROM wc) AS compute_cost_usd,
  FALSE AS compute_cost_is_estimate, CAST(NULL AS DOUBLE) AS real_billed_discount_ratio,
  (SELECT round(sum(total_exec_ms)::DOUBLE / 1000.0, 6) FROM ex) AS total_compute_seconds,
  (SELECT CAST(sum(total_queries) AS BIGINT) FROM ex) AS total_queries,
  (SELECT round(sum(active_users)::DOUBLE / count(DISTINCT day), 6) FROM active WHERE user_type = 'PERSON') AS active_users_human,
  (SELECT round(sum(active_users)::DOUBLE / count(DISTINCT day), 6) FROM active WHERE user_type <> 'PERSON') AS active_users_service,
  (SELECT CAST(sum(failed_count) AS BIGINT) FROM ex) AS failed_query_count,
  (SELECT CAST(sum(count) AS BIGINT) FROM obj WHERE object_type IN ('Tables', 'Views')) AS total_tables,
  (SELECT CAST(sum(count) AS BIGINT) FROM obj WHERE object_type = 'Schemas') AS total_schemas,
  (SELECT CAST(sum(count) AS BIGINT) FROM obj WHERE object_type = 'Databases') AS total_databases_or_catalogs,
  (SELECT round(gb, 6) FROM gb) AS total_storage_gb,
  (SELECT CAST(sum(total_runs) AS BIGINT) FROM tasks) AS automation_run_count,
  (SELECT round(sum(succeeded)::DOUBLE / sum(total_runs)::DOUBLE * 100, 6) FROM tasks) AS automation_success_rate_percent
"""
W_VIEWS = (WH, "w_users", TS, BL, MET, "w_objects", "w_task_history")
W_CTES = (
    TYPED_CTES
    | RATE_CTES
    | {"active": ACTIVE_BY_TYPE, "ex": EXEC, "wc": WH_CREDITS, "live": LIVE, "gb": STORAGE_GB, "obj": OBJECTS, "tasks": TASKS}
)
case("w_platform_summary", _w_summary, W_SUMMARY, *W_VIEWS, ctes=W_CTES)


def _l_summary(t):
    """From staged rollups, one pass over each log."""
    stage = stage_to(scratch_dir(t.spark, "summary-rollups"))
    costs = stage("costs", priced(t, "usage_date", "sku_name"))
    cube = stage("query_cube", activity.l_query_cube(t[LH], EV))
    return summary.l_platform_summary(
        cube,
        users.l_daily_active_users(users.l_audit_rollup(t["l_audit"], EV)),
        costs,
        inventory.l_object_inventory(t["l_tables"]),
        inventory.l_catalog_schema_counts(t["l_catalogs"], t["l_schemata"]),
        storage.l_storage(sizes(t)),
        automation.l_job_totals(job_rollup(t)),
        cost.l_real_billed_total(billable(t), cost.l_daily_cost(costs)),
        L_DAYS,
        GENERATED,
    )


L_SUMMARY = f"""
SELECT 'lakehouse' AS platform, {L_DAYS} AS lookback_days, '{GENERATED}' AS generated_at,
  (SELECT real_total_usd FROM real) AS total_cost_usd, FALSE AS cost_is_estimate,
  (SELECT round(sum(usd), 6) FROM sku WHERE contains(sku_name, 'COMPUTE')) AS compute_cost_usd,
  TRUE AS compute_cost_is_estimate,
  (SELECT round(real_total_usd / (SELECT round(sum(usd), 6) FROM daily), 6) FROM real) AS real_billed_discount_ratio,
  (SELECT round(sum(total_exec_ms)::DOUBLE / 1000.0, 6) FROM roll) AS total_compute_seconds,
  (SELECT total_queries FROM ov) AS total_queries,
  (SELECT round(sum(distinct_users)::DOUBLE / count(DISTINCT day), 6) FROM dau WHERE actor_type = 'person') AS active_users_human,
  (SELECT round(sum(distinct_users)::DOUBLE / count(DISTINCT day), 6) FROM dau WHERE actor_type = 'service') AS active_users_service,
  (SELECT CAST(sum(failed_count) AS BIGINT) FROM roll) AS failed_query_count,
  (SELECT CAST(sum(object_count) AS BIGINT) FROM lobj) AS total_tables,
  (SELECT object_count FROM cat WHERE object_type = 'SCHEMA') AS total_schemas,
  (SELECT object_count FROM cat WHERE object_type = 'CATALOG') AS total_databases_or_catalogs,
  (SELECT round(CAST(sum(size_bytes) AS BIGINT) / {GB}::DOUBLE, 6) FROM sizes) AS total_storage_gb,
  (SELECT total_runs FROM jt) AS automation_run_count,
  (SELECT success_rate_percent FROM jt) AS automation_success_rate_percent
"""
L_VIEWS = (*COMPUTE_VIEWS, *PV, "l_audit", "l_tables", "l_catalogs", "l_schemata", MANIFEST, JR)
L_CTES = (
    COMPUTE_CTES
    | REAL_CTES
    | SIZED
    | {"real": REAL, "sku": BY_SKU, "ov": L_OVERVIEW, "dau": DAILY_ACTIVE, "lobj": L_OBJECTS, "cat": CATALOGS}
    | {"jr": JOB_ROLL, "jt": JOB_TOTALS}
)
case("l_platform_summary", _l_summary, L_SUMMARY, *L_VIEWS, ctes=L_CTES)


case("summary_json", lambda t: _stored(t, "summary", _w_summary(t)), W_SUMMARY, *W_VIEWS, ctes=W_CTES)
case(
    "overview",
    lambda t: warehouse.overview(
        activity.w_daily_query_stats(t[WH], EV),
        total_credits(t),
        cost.w_cost_basis(bill(t)),
        users.w_active_user_count(t["w_users"]),
        storage.w_storage_summary(t[TS]),
        EV.days,
    ),
    "SELECT min(day) AS first_day, max(day) AS last_day, CAST(CAST(max(day) AS DATE) - CAST(min(day) AS DATE) + 1 AS INT) AS day_count, "
    "CAST(sum(query_count) AS BIGINT) AS total_queries, 'cost' AS headline, (SELECT round(sum(usd), 6) FROM bill) AS headline_value, "
    "(SELECT count(*) FROM w_users WHERE deleted_on IS NULL AND NOT disabled) AS active_users, (SELECT round(gb, 6) FROM gb) AS active_gb FROM by_user",
    WH,
    BL,
    "w_users",
    TS,
    ctes=BILL | {"by_user": BY_USER, "live": LIVE, "gb": STORAGE_GB},
)


def _l_overview(t):
    daily = cost.l_daily_cost(priced(t, "usage_date"))
    return lakehouse.overview(activity.l_overview(t[LH], EV), daily, cost.l_real_billed_total(billable(t), daily), EV.days)


case(
    "l_report_overview",
    _l_overview,
    f"SELECT {EV.days} AS lookback_days, o.*, (SELECT round(sum(usd), 6) FROM daily) AS total_cost_usd, "
    "(SELECT real_total_usd FROM real) AS real_total_usd FROM ov o",
    LH,
    *PV,
    ctes=REAL_CTES | {"real": REAL, "ov": L_OVERVIEW},
)

# ---- comparison: the two summaries, named w and l
C_VIEWS = tuple(dict.fromkeys((*W_VIEWS, *L_VIEWS)))
C_CTES = W_CTES | L_CTES | {"w": W_SUMMARY, "l": L_SUMMARY}
RATE_L = "(SELECT CASE WHEN total_compute_seconds > 0 THEN compute_cost_usd / total_compute_seconds ELSE 0 END FROM l)"
PROJECTION = (
    f"SELECT w.total_compute_seconds AS compute_seconds, w.compute_cost_usd AS w_compute_cost_usd, round({RATE_L}, 9) AS l_rate_per_second, "
    f"round(w.total_compute_seconds * {RATE_L}, 6) AS projected_usd, "
    f"round(w.total_compute_seconds * {RATE_L} * l.real_billed_discount_ratio, 6) AS projected_usd_adjusted, "
    "l.real_billed_discount_ratio AS ratio_applied FROM w, l"
)


def _stored(t, name, row):
    path = scratch_dir(t.spark, name)
    write_summary_json(row, path)
    return read_summary_json(t.spark, path)


STORES: dict[str, str] = {}


def _both(t):
    """The two summaries as their reports leave them: published once per session and data, then looked up."""
    session = t.spark.sparkContext.applicationId
    store = STORES.setdefault(session, scratch_dir(t.spark, "summaries"))

    def side(platform, days, build):
        return published_or(t.spark, f"{store}/{t.sf_dir.strip('/')}", platform, days, GENERATED, lambda: build(t))

    return side("warehouse", DAYS, _w_summary), side("lakehouse", L_DAYS, _l_summary)


case(
    "lookback_mismatch",
    lambda t: comparison.lookback_mismatch(*_both(t)),
    "SELECT w.lookback_days AS w_lookback_days, l.lookback_days AS l_lookback_days, abs(w.lookback_days - l.lookback_days) > 2 AS mismatch, "
    "CASE WHEN abs(w.lookback_days - l.lookback_days) > 2 THEN concat('The windows differ: ', w.lookback_days, ' days against ', "
    "l.lookback_days, ' days. Volumes are not comparable until both cover the same days.') END AS message FROM w, l",
    *C_VIEWS,
    ctes=C_CTES,
)
case("migration_projection", lambda t: comparison.migration_projection(*_both(t)), PROJECTION, *C_VIEWS, ctes=C_CTES)


def _delta(col: str, prefix: str) -> str:
    return (
        f"round(abs(({col} - w_compute_cost_usd) / w_compute_cost_usd * 100), 6) AS {prefix}delta_percent, "
        f"CASE WHEN {col} >= w_compute_cost_usd THEN 'more' ELSE 'less' END AS {prefix}direction"
    )


case(
    "projection_delta",
    lambda t: comparison.projection_delta(comparison.migration_projection(*_both(t))),
    f"SELECT {_delta('projected_usd', '')}, {_delta('projected_usd_adjusted', 'adjusted_')} FROM pr",
    *C_VIEWS,
    ctes=C_CTES | {"pr": PROJECTION},
)


def _row(metric: str, wv: str, lv: str, wb: str = "NULL", lb: str = "NULL") -> str:
    return (
        f"SELECT '{metric}' AS metric, CAST({wv} AS DOUBLE) AS w_value, CAST({lv} AS DOUBLE) AS l_value, "
        f"CAST({wb} AS VARCHAR) AS w_basis, CAST({lb} AS VARCHAR) AS l_basis FROM w, l, pr"
    )


def _basis(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 'estimate' ELSE 'real' END"


_WB = _basis("w.compute_cost_is_estimate")
_SAME = {
    "lookback_days": "lookback_days",
    "total_queries": "total_queries",
    "failed_queries": "failed_query_count",
    "total_compute_seconds": "total_compute_seconds",
    "avg_daily_person_users": "active_users_human",
    "avg_daily_service_users": "active_users_service",
    "total_storage_gb": "total_storage_gb",
    "automation_runs": "automation_run_count",
    "automation_success_percent": "automation_success_rate_percent",
    "databases_or_catalogs": "total_databases_or_catalogs",
    "schemas": "total_schemas",
    "tables_and_views": "total_tables",
}
TABLE = " UNION ALL ".join(
    [_row(m, f"w.{c}", f"l.{c}") for m, c in _SAME.items()]
    + [
        _row("total_cost_usd", "w.total_cost_usd", "l.total_cost_usd", _basis("w.cost_is_estimate"), _basis("l.cost_is_estimate")),
        _row("compute_cost_usd", "w.compute_cost_usd", "l.compute_cost_usd", _WB, _basis("l.compute_cost_is_estimate")),
        _row("workload_compute_seconds", "w.total_compute_seconds", "w.total_compute_seconds"),
        _row("observed_compute_cost_or_rate", "w.compute_cost_usd", "pr.l_rate_per_second", _WB, "'estimate'"),
        _row("projected_cost_usd", "w.compute_cost_usd", "pr.projected_usd", _WB, "'estimate'"),
        _row("projected_cost_adjusted_usd", "NULL", "pr.projected_usd_adjusted", "NULL", "'estimate'"),
        _row(
            "failure_rate_percent",
            "round(w.failed_query_count::DOUBLE / w.total_queries::DOUBLE * 100, 6)",
            "round(l.failed_query_count::DOUBLE / l.total_queries::DOUBLE * 100, 6)",
        ),
    ]
)
case("comparison_table", lambda t: comparison.comparison_table(*_both(t)), TABLE, *C_VIEWS, ctes=C_CTES | {"pr": PROJECTION})
