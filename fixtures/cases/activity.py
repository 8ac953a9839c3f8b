"""Query activity on both sides, credits."""

from fixtures.cases.registry import E_SINCE, E_UNTIL, EV, GB, case, day
from fixtures.views import DOMAIN, EMPLOYEES
from meterlens.operators import activity as a
from meterlens.operators import ranking, users
from meterlens.sources import cluster_names, endpoint_names, user_types

WH, LH = "w_query_history", "l_query_history"
RECENT = f"start_time >= {E_SINCE} AND start_time < {E_UNTIL}"
DAY = day("start_time")

case(
    "w_daily_query_stats",
    lambda t: a.w_daily_query_stats(t[WH], EV),
    f"SELECT {DAY} AS day, count(*) AS query_count, count(DISTINCT user_name) AS active_users FROM {WH} WHERE {RECENT} GROUP BY 1",
    WH,
)
BY_USER = f"SELECT {DAY} AS day, user_name, count(*) AS query_count FROM {WH} WHERE {RECENT} GROUP BY 1, 2"
case("w_daily_query_by_user", lambda t: a.w_daily_query_by_user(t[WH], EV), BY_USER, WH)

# one row per live user; the classification is spelled out again for the oracle
USER_TYPES = "SELECT user_name, user_type FROM w_users WHERE deleted_on IS NULL"
EMPLOYEE = "coalesce(lower({0}) LIKE '%@corp.example', FALSE)"
CLASSIFIED = (
    "CASE WHEN coalesce(trim({1}),'')<>'' THEN {1} WHEN " + EMPLOYEE + " THEN 'PERSON' ELSE 'Unclassified' END"
)
TYPED = (
    f"SELECT b.day, b.user_name, b.query_count, {CLASSIFIED.format('b.user_name', 'u.user_type')} AS user_type "
    "FROM by_user b LEFT JOIN types u ON b.user_name = u.user_name"
)
TYPED_CTES = {"types": USER_TYPES, "by_user": BY_USER, "typed": TYPED}


def _by_user_types(t):
    return a.w_daily_query_by_user(t[WH], EV), user_types(t["w_users"]), DOMAIN


case("user_type_lookup", lambda t: users.user_type_lookup(*_by_user_types(t)), "SELECT * FROM typed", WH, "w_users", ctes=TYPED_CTES)
case(
    "w_daily_volume_by_type",
    lambda t: users.w_daily_volume_by_type(*_by_user_types(t)),
    "SELECT day, user_type, CAST(sum(query_count) AS BIGINT) AS query_count FROM typed GROUP BY 1, 2",
    WH,
    "w_users",
    ctes=TYPED_CTES,
)
ACTIVE_BY_TYPE = "SELECT day, user_type, count(*) AS active_users FROM typed GROUP BY 1, 2"
case(
    "w_daily_active_by_type",
    lambda t: users.w_daily_active_by_type(*_by_user_types(t)),
    ACTIVE_BY_TYPE,
    WH,
    "w_users",
    ctes=TYPED_CTES,
)
BUCKET = f"CASE WHEN {EMPLOYEE} THEN '{EMPLOYEES}' ELSE {{0}} END"
case(
    "w_top_users",
    lambda t: users.w_top_users(t[WH], EV, DOMAIN, EMPLOYEES),
    f"SELECT {BUCKET.format('user_name')} AS user_name, count(*) AS query_count FROM {WH} WHERE {RECENT} GROUP BY 1 "
    "ORDER BY query_count DESC, 1 NULLS FIRST LIMIT 20",
    WH,
)
DB_ACTIVITY = (
    f"SELECT {DAY} AS day, database_name, count(*) AS query_count FROM {WH} "
    f"WHERE {RECENT} AND database_name IS NOT NULL GROUP BY 1, 2"
)
case("w_database_activity", lambda t: a.w_database_activity(t[WH], EV), DB_ACTIVITY, WH)
TOP_DBS = "SELECT database_name FROM act GROUP BY 1 ORDER BY sum(query_count) DESC, 1 LIMIT 6"
case(
    "w_database_activity_trend",
    lambda t: a.w_database_activity_trend(a.w_database_activity(t[WH], EV)),
    "SELECT day, CASE WHEN database_name IN (SELECT database_name FROM top) THEN database_name ELSE 'Other' END AS database_name, "
    "CAST(sum(query_count) AS BIGINT) AS query_count FROM act GROUP BY 1, 2",
    WH,
    ctes={"act": DB_ACTIVITY, "top": TOP_DBS},
)

SPILL = "bytes_spilled_to_local_storage + bytes_spilled_to_remote_storage"
QUEUE = "queued_provisioning_time + queued_overload_time"
case(
    "w_resource_signals",
    lambda t: a.w_resource_signals(a.w_warehouse_rollup(t[WH], EV)),
    "SELECT warehouse_name, count(*) AS query_count, "
    f"CAST(sum(CASE WHEN {SPILL} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_with_spill, "
    f"CAST(sum({SPILL}) AS BIGINT) / {GB}::DOUBLE AS total_spilled_gb, "
    f"CAST(sum(CASE WHEN {QUEUE} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_with_queueing, "
    f"CAST(sum({QUEUE}) AS BIGINT) / 1000.0::DOUBLE AS total_queued_seconds "
    f"FROM {WH} WHERE {RECENT} GROUP BY 1 HAVING sum({SPILL}) > 0 OR sum({QUEUE}) > 0 "
    "ORDER BY queries_with_spill + queries_with_queueing DESC, warehouse_name NULLS FIRST LIMIT 15",
    WH,
)
EXEC = (
    "SELECT warehouse_name, count(*) AS total_queries, CAST(sum(execution_time) AS BIGINT) AS total_exec_ms, "
    "CAST(sum(CASE WHEN execution_status <> 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS failed_count, "
    "CAST(sum(CASE WHEN execution_status <> 'SUCCESS' THEN execution_time ELSE 0 END) AS BIGINT) AS failed_exec_ms "
    f"FROM {WH} WHERE {RECENT} GROUP BY 1"
)


def exec_stats(t):
    return a.w_exec_stats(a.w_warehouse_rollup(t[WH], EV))


case("w_exec_stats", exec_stats, EXEC, WH)
case(
    "w_failed_waste",
    lambda t: a.w_failed_waste(exec_stats(t)),
    "SELECT warehouse_name, failed_count AS failed_query_count, failed_exec_ms / 1000.0::DOUBLE AS wasted_seconds FROM ex "
    "WHERE failed_count > 0 ORDER BY failed_exec_ms DESC, warehouse_name NULLS FIRST LIMIT 15",
    WH,
    ctes={"ex": EXEC},
)
FAILURE = (
    "SELECT CAST(sum(total_queries) AS BIGINT) AS total_queries, CAST(sum(failed_count) AS BIGINT) AS failed_queries, "
    "round(sum(failed_count)::DOUBLE / sum(total_queries)::DOUBLE * 100, 6) AS failure_rate_percent, "
    "round(sum(failed_exec_ms)::DOUBLE / 1000.0 / 3600.0, 6) AS wasted_hours FROM ex"
)
case("failure_rate", lambda t: a.failure_rate(exec_stats(t)), FAILURE, WH, ctes={"ex": EXEC})
case(
    "w_top_errors",
    lambda t: a.w_top_errors(t[WH], EV),
    "SELECT coalesce(error_code, 'UNKNOWN') AS error_code, substring(coalesce(min(error_message), ''), 1, 160) AS sample_message, "
    f"count(*) AS count FROM {WH} WHERE {RECENT} AND execution_status <> 'SUCCESS' GROUP BY 1 ORDER BY count DESC, 1 LIMIT 15",
    WH,
)
case(
    "w_daily_duration",
    lambda t: a.w_daily_duration(t[WH], EV),
    f"SELECT {DAY} AS day, min(execution_time) / 1000.0::DOUBLE AS min_seconds, "
    "quantile_disc(execution_time, 0.25) / 1000.0::DOUBLE AS q1_seconds, "
    "quantile_disc(execution_time, 0.5) / 1000.0::DOUBLE AS median_seconds, "
    "quantile_disc(execution_time, 0.75) / 1000.0::DOUBLE AS q3_seconds, max(execution_time) / 1000.0::DOUBLE AS max_seconds "
    f"FROM {WH} WHERE {RECENT} AND execution_time > 0 GROUP BY 1",
    WH,
)

MET = "w_metering"
DAILY_CREDITS = f"SELECT {DAY} AS day, round(sum(credits_used), 6) AS credits FROM {MET} WHERE {RECENT} GROUP BY 1"
TOTAL_CREDITS = f"SELECT round(sum(credits_used), 6) AS total_credits FROM {MET} WHERE {RECENT}"
WH_CREDITS = f"SELECT warehouse_name, round(sum(credits_used), 6) AS total_credits FROM {MET} WHERE {RECENT} GROUP BY 1"
TOP_WH_CREDITS = f"{WH_CREDITS} ORDER BY total_credits DESC, warehouse_name LIMIT 15"
case("w_daily_credits", lambda t: a.w_daily_credits(t[MET], EV), DAILY_CREDITS, MET)
case("w_total_credits", lambda t: a.w_total_credits(t[MET], EV), TOTAL_CREDITS, MET)
case("w_credits_by_warehouse", lambda t: a.w_credits_by_warehouse(t[MET], EV), TOP_WH_CREDITS, MET)

# ---- lakehouse
L_OVERVIEW = f"SELECT count(*) AS total_queries, count(DISTINCT executed_by) AS active_users FROM {LH} WHERE {RECENT}"
case("l_overview", lambda t: a.l_overview(t[LH], EV), L_OVERVIEW, LH)
case(
    "l_daily_query_volume",
    lambda t: a.l_daily_query_volume(t[LH], EV),
    f"SELECT {DAY} AS day, count(*) AS query_count, count(DISTINCT executed_by) AS active_users FROM {LH} WHERE {RECENT} GROUP BY 1",
    LH,
)
ACTOR = "CASE WHEN {0} LIKE '%@%' THEN 'person' ELSE 'service' END"
VOLUME_BY_TYPE = (
    f"SELECT {DAY} AS day, {ACTOR.format('executed_by')} AS actor_type, count(*) AS query_count FROM {LH} WHERE {RECENT} GROUP BY 1, 2"
)
case("l_daily_volume_by_type", lambda t: a.l_daily_volume_by_type(t[LH], EV), VOLUME_BY_TYPE, LH)
case(
    "densify_daily_series",
    lambda t: ranking.densify_daily_series(
        a.w_database_activity(t[WH], EV), "database_name", "query_count"
    ),
    "SELECT d.day, k.database_name, coalesce(v.query_count, 0) AS query_count FROM (SELECT DISTINCT day FROM v) d "
    "CROSS JOIN (SELECT DISTINCT database_name FROM v) k LEFT JOIN v ON v.day = d.day AND v.database_name = k.database_name",
    WH,
    ctes={"v": DB_ACTIVITY},
)
case(
    "l_daily_duration",
    lambda t: a.l_daily_duration(t[LH], EV),
    f"SELECT {DAY} AS day, min(total_duration_ms) AS min_ms, quantile_disc(total_duration_ms, 0.25) AS q1_ms, "
    "quantile_disc(total_duration_ms, 0.5) AS median_ms, quantile_disc(total_duration_ms, 0.75) AS q3_ms, "
    f"max(total_duration_ms) AS max_ms FROM {LH} WHERE {RECENT} AND total_duration_ms > 0 GROUP BY 1",
    LH,
)
ENDPOINTS = (
    "SELECT json_extract_string(r, '$.id') AS id, json_extract_string(r, '$.name') AS name FROM ("
    "SELECT unnest(CASE WHEN json_valid(payload) THEN json_extract(payload, '$.warehouses[*]') END) AS r FROM l_endpoints)"
)
CLUSTERS = "SELECT cluster_id, cluster_name FROM l_clusters WHERE delete_time IS NULL"
ROLLUP = (
    "SELECT compute_type, warehouse_id, cluster_id, count(*) AS total_queries, "
    "CAST(sum(total_duration_ms) AS BIGINT) AS total_exec_ms, "
    "CAST(sum(CASE WHEN execution_status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed_count, "
    "CAST(sum(CASE WHEN execution_status = 'FAILED' THEN total_duration_ms ELSE 0 END) AS BIGINT) AS failed_exec_ms, "
    "CAST(sum(CASE WHEN spilled_local_bytes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_with_spill, "
    "CAST(sum(spilled_local_bytes) AS BIGINT) AS total_spilled_bytes, "
    "CAST(sum(CASE WHEN waiting_for_compute_duration_ms > 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_with_queueing, "
    "CAST(sum(waiting_for_compute_duration_ms) AS BIGINT) AS total_queued_ms "
    f"FROM {LH} WHERE {RECENT} GROUP BY 1, 2, 3"
)
NAMED = (
    "SELECT CASE WHEN r.warehouse_id IS NOT NULL THEN coalesce(e.name, r.warehouse_id) "
    "WHEN r.cluster_id IS NOT NULL THEN coalesce(c.cluster_name, r.cluster_id) ELSE r.compute_type END AS compute_id, r.* "
    "FROM roll r LEFT JOIN endpoints e ON r.warehouse_id = e.id LEFT JOIN clusters c ON r.cluster_id = c.cluster_id"
)
COMPUTE_VIEWS = (LH, "l_endpoints", "l_clusters")
COMPUTE_CTES = {"endpoints": ENDPOINTS, "clusters": CLUSTERS, "roll": ROLLUP, "named": NAMED}


def _compute(t):
    return a.l_compute_rollup(t[LH], EV), endpoint_names(t["l_endpoints"]), cluster_names(t["l_clusters"])


case(
    "l_compute_exec_stats",
    lambda t: a.l_compute_exec_stats(*_compute(t)),
    "SELECT compute_id, compute_type, total_queries, total_exec_ms, failed_count, failed_exec_ms FROM named",
    *COMPUTE_VIEWS,
    ctes=COMPUTE_CTES,
)
case(
    "l_compute_signals",
    lambda t: a.l_compute_signals(*_compute(t)),
    "SELECT compute_id, compute_type, total_queries AS query_count, queries_with_spill, total_spilled_bytes, "
    "queries_with_queueing, total_queued_ms FROM named",
    *COMPUTE_VIEWS,
    ctes=COMPUTE_CTES,
)
case(
    "l_top_errors",
    lambda t: a.l_top_errors(t[LH], EV),
    "SELECT coalesce(nullif(regexp_extract(error_message, '^\\[([A-Z_0-9]+)\\]', 1), ''), 'OTHER') AS error_class, "
    f"min(error_message) AS sample_message, count(*) AS count FROM {LH} WHERE {RECENT} AND execution_status = 'FAILED' "
    "GROUP BY 1 ORDER BY count DESC, 1 LIMIT 15",
    LH,
)
