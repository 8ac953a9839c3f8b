"""Users, service accounts, audit."""

from pyspark.sql import functions as F

from fixtures.cases.activity import ACTIVE_BY_TYPE, ACTOR, CLASSIFIED, EMPLOYEE, LH, RECENT, TYPED_CTES, USER_TYPES, WH
from fixtures.cases.registry import E_SINCE, E_UNTIL, EV, case, day
from fixtures.views import DOMAIN, EMPLOYEES
from meterlens.operators import access
from meterlens.operators import users as u
from meterlens.operators.activity import w_daily_query_by_user
from meterlens.sources import principal_names, user_types

case(
    "w_active_user_count",
    lambda t: u.w_active_user_count(t["w_users"]),
    "SELECT count(*) AS active_users FROM w_users WHERE deleted_on IS NULL AND NOT disabled",
    "w_users",
)
SERVICES = f"SELECT user_name FROM types WHERE upper({CLASSIFIED.format('user_name', 'user_type')}) LIKE '%SERVICE%'"
SERVICE_CTES = {"types": USER_TYPES, "services": SERVICES}
case(
    "service_account_filter",
    lambda t: u.service_account_filter(
        t[WH].filter(EV.ts("start_time")).select("query_id", "user_name"), user_types(t["w_users"]), DOMAIN
    ),
    f"SELECT query_id, user_name FROM {WH} WHERE {RECENT} AND user_name IN (SELECT user_name FROM services)",
    WH,
    "w_users",
    ctes=SERVICE_CTES,
)
SERVICE_STATS = (
    "SELECT user_name, count(*) AS query_count, count(DISTINCT warehouse_name) AS warehouse_count, "
    f"min({day('start_time')}) AS first_day, max({day('start_time')}) AS last_day FROM {WH} "
    f"WHERE {RECENT} AND user_name IN (SELECT user_name FROM services) GROUP BY 1"
)


def service_stats(t):
    return u.w_service_account_stats(t[WH], user_types(t["w_users"]), EV, DOMAIN)


case("w_service_account_stats", service_stats, SERVICE_STATS, WH, "w_users", ctes=SERVICE_CTES)

# principals by id, as the name lookup gives them
PRINCIPALS = (
    "SELECT json_extract_string(r, '$.applicationId') AS id, json_extract_string(r, '$.displayName') AS name FROM ("
    "SELECT unnest(CASE WHEN json_valid(payload) THEN json_extract(payload, '$.Resources[*]') END) AS r FROM l_principals)"
)
DISPLAY = f"CASE WHEN {EMPLOYEE} THEN '{EMPLOYEES}' ELSE coalesce(p.name, {{0}}) END"
case(
    "l_service_account_stats",
    lambda t: u.l_service_account_stats(t[LH], principal_names(t["l_principals"]), EV, DOMAIN, EMPLOYEES),
    f"SELECT {DISPLAY.format('s.executed_by')} AS actor, query_count, compute_count, first_day, last_day FROM ("
    "SELECT executed_by, count(*) AS query_count, count(DISTINCT coalesce(warehouse_id, cluster_id)) AS compute_count, "
    f"min({day('start_time')}) AS first_day, max({day('start_time')}) AS last_day FROM {LH} "
    f"WHERE {RECENT} AND executed_by NOT LIKE '%@%' GROUP BY 1) s LEFT JOIN principals p ON s.executed_by = p.id",
    LH,
    "l_principals",
    ctes={"principals": PRINCIPALS},
)

AUDIT = f"event_date >= CAST({E_SINCE} AS DATE) AND event_date < CAST({E_UNTIL} AS DATE)"
DAILY_ACTIVE = (
    f"SELECT {day('event_time')} AS day, {ACTOR.format('email')} AS actor_type, count(DISTINCT email) AS distinct_users, "
    f"count(*) AS action_count FROM l_audit WHERE {AUDIT} GROUP BY 1, 2"
)
case("l_daily_active_users", lambda t: u.l_daily_active_users(u.l_audit_rollup(t["l_audit"], EV)), DAILY_ACTIVE, "l_audit")
case(
    "l_top_actors",
    lambda t: u.l_top_actors(u.l_audit_rollup(t["l_audit"], EV), principal_names(t["l_principals"]), DOMAIN, EMPLOYEES),
    f"SELECT {DISPLAY.format('a.actor')} AS actor, CAST(sum(n) AS BIGINT) AS action_count FROM ("
    f"SELECT coalesce(email, '(unknown)') AS actor, count(*) AS n FROM l_audit WHERE {AUDIT} GROUP BY 1) a "
    "LEFT JOIN principals p ON a.actor = p.id GROUP BY 1 ORDER BY action_count DESC, 1 LIMIT 20",
    "l_audit",
    "l_principals",
    ctes={"principals": PRINCIPALS},
)
case(
    "l_actions_by_service",
    lambda t: u.l_actions_by_service(t["l_audit"], EV),
    f"SELECT service_name, count(*) AS action_count FROM l_audit WHERE {AUDIT} GROUP BY 1",
    "l_audit",
)
case(
    "avg_daily_active",
    lambda t: u.avg_daily_active(
        u.w_daily_active_by_type(w_daily_query_by_user(t[WH], EV), user_types(t["w_users"]), DOMAIN),
        F.col("user_type") == "PERSON",
        "active_users",
        "avg_active_users",
    ),
    "SELECT round(sum(active_users)::DOUBLE / count(DISTINCT day), 6) AS avg_active_users FROM active WHERE user_type = 'PERSON'",
    WH,
    "w_users",
    ctes=TYPED_CTES | {"active": ACTIVE_BY_TYPE},
)
