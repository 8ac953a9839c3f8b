"""Access history and lineage."""

from fixtures.cases.activity import BUCKET
from fixtures.cases.registry import GB, L_SINCE, L_UNTIL, LI, case
from fixtures.cases.users import DISPLAY, PRINCIPALS, SERVICE_CTES, SERVICE_STATS, service_stats
from fixtures.cases.activity import WH
from fixtures.views import DOMAIN, EMPLOYEES
from meterlens.operators import access as a
from meterlens.operators import users
from meterlens.sources import principal_names, table_sizes_from_files, user_types

AH = "w_access_history"
EVENTS = " UNION ALL ".join(
    f"SELECT query_id, user_name, {name} AS object_name, {domain} AS object_domain, '{action}' AS action FROM {AH} "
    f"WHERE query_start_time >= {L_SINCE} AND query_start_time < {L_UNTIL} AND {cond}"
    for name, domain, action, cond in (
        ("read_name", "read_domain", "READ", "has_reads"),
        ("read_name_2", "'Table'", "READ", "has_reads"),
        ("write_name", "'Table'", "WRITE", "write_name IS NOT NULL"),
    )
)
CTES = {"ev": EVENTS, "tev": "SELECT * FROM ev WHERE object_domain = 'Table'"}


def events(t):
    return a.access_events(t[AH], LI)


case("access_events", events, "SELECT * FROM ev", AH, ctes=CTES)


def _distinct(keys: str) -> str:
    return f"SELECT {keys}, count(DISTINCT query_id) AS distinct_queries FROM tev GROUP BY ALL"


case("w_table_access_counts", lambda t: a.w_table_access_counts(events(t)), _distinct("object_name"), AH, ctes=CTES)
case("w_table_rw_by_user", lambda t: a.w_table_rw_by_user(events(t)), _distinct("object_name, user_name, action"), AH, ctes=CTES)
case(
    "w_top_accessed_tables",
    lambda t: a.w_top_accessed_tables(a.w_table_access_counts(events(t))),
    f"{_distinct('object_name')} ORDER BY distinct_queries DESC, object_name LIMIT 30",
    AH,
    ctes=CTES,
)
ACTIONS = _distinct("user_name, action")
case("w_user_action_counts", lambda t: a.w_user_action_counts(events(t)), ACTIONS, AH, ctes=CTES)
case(
    "w_user_table_counts",
    lambda t: a.w_user_table_counts(events(t), user_types(t["w_users"]), DOMAIN),
    "SELECT user_name, object_name, count(DISTINCT query_id) AS distinct_queries FROM tev "
    "WHERE user_name IN (SELECT user_name FROM services) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50",
    AH,
    "w_users",
    ctes=CTES | SERVICE_CTES,
)
case(
    "service_account_summary",
    lambda t: users.service_account_summary(service_stats(t), a.w_user_action_counts(events(t))),
    "SELECT s.*, coalesce(r.distinct_queries, 0) AS read_count, coalesce(w.distinct_queries, 0) AS write_count FROM stats s "
    "LEFT JOIN actions r ON r.user_name = s.user_name AND r.action = 'READ' "
    "LEFT JOIN actions w ON w.user_name = s.user_name AND w.action = 'WRITE'",
    AH,
    WH,
    "w_users",
    ctes=CTES | SERVICE_CTES | {"stats": SERVICE_STATS, "actions": ACTIONS},
)

TS = "w_table_storage"
LIVE = (
    "SELECT concat(table_catalog, '.', table_schema, '.', table_name) AS qualified_name, "
    "coalesce(active_bytes, 0) AS bytes, coalesce(time_travel_bytes, 0) AS tt, coalesce(failsafe_bytes, 0) AS fs "
    f"FROM {TS} WHERE NOT deleted"
)
case(
    "dead_tables",
    lambda t: a.dead_tables(t[TS], events(t)),
    f"SELECT qualified_name, bytes / {GB}::DOUBLE AS active_gb FROM live "
    "WHERE upper(qualified_name) NOT IN (SELECT upper(object_name) FROM tev) ORDER BY bytes DESC, qualified_name LIMIT 30",
    AH,
    TS,
    ctes=CTES | {"live": LIVE},
)
case(
    "size_vs_access",
    lambda t: a.size_vs_access(t[TS], events(t)),
    f"SELECT qualified_name, bytes / {GB}::DOUBLE AS active_gb, coalesce(n, 0) AS distinct_queries FROM ("
    "SELECT * FROM live ORDER BY bytes DESC, qualified_name LIMIT 200) LEFT JOIN ("
    "SELECT upper(object_name) AS m, count(DISTINCT query_id) AS n FROM tev GROUP BY 1) ON upper(qualified_name) = m",
    AH,
    TS,
    ctes=CTES | {"live": LIVE},
)
case(
    "w_table_access_detail",
    lambda t: a.w_table_access_detail(t[TS], a.by_query(events(t)), DOMAIN, EMPLOYEES),
    f"SELECT o.own AS qualified_name, coalesce(l.bytes, 0) / {GB}::DOUBLE AS active_gb, user_name, read_count, write_count FROM ("
    f"SELECT upper(object_name) AS qualified_name, {BUCKET.format('user_name')} AS user_name, "
    "count(DISTINCT CASE WHEN action = 'READ' THEN query_id END) AS read_count, "
    "count(DISTINCT CASE WHEN action = 'WRITE' THEN query_id END) AS write_count FROM tev GROUP BY 1, 2 "
    "ORDER BY read_count + write_count DESC, 1, 2 NULLS FIRST LIMIT 150) d LEFT JOIN ("
    "SELECT upper(qualified_name) AS m, CAST(sum(bytes) AS BIGINT) AS bytes FROM live GROUP BY 1) l ON d.qualified_name = l.m "
    "JOIN (SELECT upper(object_name) AS m, min(object_name) AS own FROM tev GROUP BY 1) o ON d.qualified_name = o.m",
    AH,
    TS,
    ctes=CTES | {"live": LIVE},
)

# ---- lineage
LIN = "l_lineage"
L_RECENT = f"event_date >= CAST({L_SINCE} AS DATE) AND event_date < CAST({L_UNTIL} AS DATE)"


def _visible(side: str) -> str:
    return f"({side}_table_schema IS NULL OR left({side}_table_schema, 2) <> '__')"


def _side(side: str) -> str:
    return f"{L_RECENT} AND {side}_table_full_name IS NOT NULL AND {_visible(side)}"


for name, side, action in (("read", "source", "READ"), ("write", "target", "WRITE")):
    table = f"{side}_table_full_name"
    case(
        f"l_top_{name}_tables",
        (lambda t: a.l_top_read_tables(t[LIN], LI)) if name == "read" else (lambda t: a.l_top_write_tables(t[LIN], LI)),
        f"SELECT '{action}' AS direction, {table} AS table_name, count(*) AS access_count FROM {LIN} WHERE {_side(side)} "
        "GROUP BY 2 ORDER BY access_count DESC, table_name LIMIT 20",
        LIN,
    )
    case(
        f"l_user_table_{name}s",
        (lambda t: a.l_user_table_reads(t[LIN], LI)) if name == "read" else (lambda t: a.l_user_table_writes(t[LIN], LI)),
        f"SELECT created_by AS actor, {table} AS table_name, '{action}' AS direction, count(*) AS access_count FROM {LIN} "
        f"WHERE {_side(side)} AND created_by IS NOT NULL GROUP BY 1, 2 ORDER BY access_count DESC, 1, 2 LIMIT 150",
        LIN,
    )

MANIFEST = "l_file_manifest"
TOUCHES = " UNION ALL ".join(
    f"SELECT created_by, {side}_table_full_name AS table_name, {r} AS r, {1 - r} AS w FROM {LIN} "
    f"WHERE {_side(side)} AND created_by IS NOT NULL"
    for side, r in (("source", 1), ("target", 0))
)
SIZES = f"SELECT qualified_name, format, count(*) AS num_files, CAST(sum(length) AS BIGINT) AS size_bytes FROM {MANIFEST} GROUP BY 1, 2"
case(
    "l_table_access_detail",
    lambda t: a.l_table_access_detail(
        t[LIN], principal_names(t["l_principals"]), table_sizes_from_files(t[MANIFEST]), DOMAIN, EMPLOYEES, LI
    ),
    "SELECT d.*, s.size_bytes FROM ("
    f"SELECT {DISPLAY.format('x.created_by')} AS actor, table_name, CAST(sum(r) AS BIGINT) AS read_count, "
    "CAST(sum(w) AS BIGINT) AS write_count FROM touches x LEFT JOIN principals p ON x.created_by = p.id GROUP BY 1, 2 "
    "ORDER BY read_count + write_count DESC, 1, 2 LIMIT 150) d LEFT JOIN sizes s ON d.table_name = s.qualified_name",
    LIN,
    "l_principals",
    MANIFEST,
    ctes={"touches": TOUCHES, "principals": PRINCIPALS, "sizes": SIZES},
)
case(
    "l_service_account_tables",
    lambda t: a.l_service_account_tables(t[LIN], principal_names(t["l_principals"]), DOMAIN, EMPLOYEES, LI),
    f"SELECT {DISPLAY.format('x.created_by')} AS actor, table_name, access_count FROM ("
    "SELECT created_by, coalesce(source_table_full_name, target_table_full_name) AS table_name, count(*) AS access_count "
    f"FROM {LIN} WHERE {L_RECENT} AND created_by NOT LIKE '%@%' AND {_visible('source')} AND {_visible('target')} "
    "GROUP BY 1, 2 ORDER BY access_count DESC, 1, 2 NULLS FIRST LIMIT 30) x LEFT JOIN principals p ON x.created_by = p.id",
    LIN,
    "l_principals",
    ctes={"principals": PRINCIPALS},
)
