"""Column expressions, each as a projection over a whole usage table."""

from pyspark.sql import functions as F

from fixtures.cases.access import LIN, TS
from fixtures.cases.activity import ACTOR, CLASSIFIED, CLUSTERS, EMPLOYEE, BUCKET, ENDPOINTS, LH, WH
from fixtures.cases.inventory import BASE_CLIENT, DT, FRIENDLY, IP_LONG, STATEMENT, TASK_ROWS
from fixtures.cases.registry import E_SINCE, E_UNTIL, EV, GB, O_SINCE, O_UNTIL, OR, case
from fixtures.cases.users import DISPLAY, PRINCIPALS
from fixtures.views import DOMAIN, EMPLOYEES, K, View, VIEWS
from meterlens import functions as f
from meterlens.operators.lookup import attach, with_compute_names
from meterlens.sources import cluster_names, endpoint_names, job_tasks_from_json, principal_names

BL, AT = "w_billing", "w_attribution"

case(
    "lookback_ts",
    lambda t: t[WH].filter(f.lookback_ts("start_time", EV.as_of, EV.days)).select("query_id"),
    f"SELECT query_id FROM {WH} WHERE start_time >= {E_SINCE} AND start_time < {E_UNTIL}",
    WH,
)
case(
    "lookback_date",
    lambda t: t[BL].filter(f.lookback_date("usage_date", OR.as_of, OR.days)).select("usage_date", "usage_type"),
    f"SELECT usage_date, usage_type FROM {BL} WHERE usage_date >= CAST({O_SINCE} AS DATE) AND usage_date < CAST({O_UNTIL} AS DATE)",
    BL,
)
case(
    "not_deleted",
    lambda t: t["w_users"].filter(f.not_deleted("deleted_on")).select("user_name"),
    "SELECT user_name FROM w_users WHERE deleted_on IS NULL",
    "w_users",
)
case("day_of", lambda t: t[WH].select("query_id", f.day_of("start_time").alias("day")), f"SELECT query_id, strftime(start_time, '%Y-%m-%d') AS day FROM {WH}", WH)
case("month_of", lambda t: t[BL].select(f.month_of("usage_date").alias("month")), f"SELECT strftime(usage_date, '%Y-%m') AS month FROM {BL}", BL)
case(
    "positive_duration",
    lambda t: t[WH].filter(f.positive_duration("execution_time")).select("query_id", "execution_time"),
    f"SELECT query_id, execution_time FROM {WH} WHERE execution_time > 0",
    WH,
)
case(
    "actor_type",
    lambda t: t[LH].select("executed_by", f.actor_type("executed_by").alias("actor_type")),
    f"SELECT executed_by, {ACTOR.format('executed_by')} AS actor_type FROM {LH}",
    LH,
)
case(
    "is_employee",
    lambda t: t[WH].select("user_name", f.is_employee("user_name", DOMAIN).alias("is_employee")),
    f"SELECT user_name, {EMPLOYEE.format('user_name')} AS is_employee FROM {WH}",
    WH,
)
case(
    "classify_user_type",
    lambda t: t["w_users"].select("user_name", f.classify_user_type("user_name", "user_type", DOMAIN).alias("label")),
    f"SELECT user_name, {CLASSIFIED.format('user_name', 'user_type')} AS label FROM w_users",
    "w_users",
)
case(
    "is_service_account",
    lambda t: t["w_users"].select("user_name", f.is_service_account("user_name", "user_type", DOMAIN).alias("is_service")),
    f"SELECT user_name, upper({CLASSIFIED.format('user_name', 'user_type')}) LIKE '%SERVICE%' AS is_service FROM w_users",
    "w_users",
)
case(
    "bucket_people",
    lambda t: t[AT].select("user_name", f.bucket_people("user_name", DOMAIN, EMPLOYEES).alias("bucket")),
    f"SELECT user_name, {BUCKET.format('user_name')} AS bucket FROM {AT}",
    AT,
)
case(
    "display_name",
    lambda t: attach(
        t["l_audit"].select(F.col("user_identity.email").alias("email")).distinct(),
        "email",
        principal_names(t["l_principals"]),
        "id",
        "name",
        "_name",
    ).select("email", f.display_name("email", "_name", DOMAIN, EMPLOYEES).alias("display_name")),
    f"SELECT email, {DISPLAY.format('a.email')} AS display_name FROM (SELECT DISTINCT email FROM l_audit) a "
    "LEFT JOIN principals p ON a.email = p.id",
    "l_audit",
    "l_principals",
    ctes={"principals": PRINCIPALS},
)
case(
    "compute_name",
    lambda t: with_compute_names(
        t[LH].select("compute.warehouse_id", "compute.cluster_id", F.col("compute.type").alias("compute_type")).distinct(),
        endpoint_names(t["l_endpoints"]),
        cluster_names(t["l_clusters"]),
    ),
    "SELECT r.*, CASE WHEN r.warehouse_id IS NOT NULL THEN coalesce(e.name, r.warehouse_id) "
    "WHEN r.cluster_id IS NOT NULL THEN coalesce(c.cluster_name, r.cluster_id) ELSE r.compute_type END AS compute_id FROM ("
    f"SELECT DISTINCT warehouse_id, cluster_id, compute_type FROM {LH}) r "
    "LEFT JOIN endpoints e ON r.warehouse_id = e.id LEFT JOIN clusters c ON r.cluster_id = c.cluster_id",
    LH,
    "l_endpoints",
    "l_clusters",
    ctes={"endpoints": ENDPOINTS, "clusters": CLUSTERS},
)
case(
    "base_client_name",
    lambda t: t["w_sessions"].select("client_application_id", f.base_client_name("client_application_id").alias("client")),
    f"SELECT client_application_id, {BASE_CLIENT} AS client FROM w_sessions",
    "w_sessions",
)
case(
    "classify_statement",
    lambda t: t["w_task_history"].select("query_text", f.classify_statement("query_text").alias("label")),
    f"SELECT query_text, {STATEMENT} AS label FROM w_task_history",
    "w_task_history",
)
case(
    "friendly_task_type",
    lambda t: job_tasks_from_json(t["l_job_payloads"]).select("task_type", f.friendly_task_type("task_type").alias("label")),
    f"SELECT task_type, {FRIENDLY} AS label FROM tasks",
    "l_job_payloads",
    ctes={"tasks": TASK_ROWS},
)
case(
    "error_class",
    lambda t: t[LH].select("error_message", f.error_class("error_message").alias("error_class")),
    f"SELECT error_message, coalesce(nullif(regexp_extract(error_message, '^\\[([A-Z_0-9]+)\\]', 1), ''), 'OTHER') AS error_class FROM {LH}",
    LH,
)
case(
    "sample_message",
    lambda t: t[WH].select("query_id", f.sample_message("error_message").alias("sample")),
    f"SELECT query_id, substring(coalesce(error_message, ''), 1, 160) AS sample FROM {WH}",
    WH,
)
case(
    "not_internal_schema",
    lambda t: t[LIN].filter(f.not_internal_schema("source_table_schema")).select("source_table_schema", "created_by"),
    f"SELECT source_table_schema, created_by FROM {LIN} WHERE source_table_schema IS NULL OR left(source_table_schema, 2) <> '__'",
    LIN,
)
case(
    "ipv4_to_long",
    lambda t: t["w_login_history"].select("client_ip", f.ipv4_to_long("client_ip").alias("address")),
    f"SELECT client_ip, {IP_LONG.format('client_ip')} AS address FROM w_login_history",
    "w_login_history",
)
# login addresses as CIDR text: every prefix length 0-32, bare addresses, and a length out of range
VIEWS["cidr_text"] = View(
    "events",
    {
        "cidr": f"CASE WHEN {K}>35 THEN concat('10.',user_id%256,'.',{K}%8,'.',event_id%250) "
        f"ELSE concat('10.',user_id%256,'.',{K}%8,'.',event_id%250,'/',{K}) END"
    },
)
CIDR = f"SELECT cidr, {IP_LONG.format('split_part(cidr, chr(47), 1)')} AS ip, CASE WHEN contains(cidr, '/') THEN CAST(split_part(cidr, '/', 2) AS INT) ELSE 32 END AS n FROM cidr_text"


def _cidr(t):
    low, high = f.cidr_range("cidr")
    return t["cidr_text"].select("cidr", low.alias("low"), high.alias("high"))


case(
    "cidr_range",
    _cidr,
    "SELECT cidr, CASE WHEN n <= 32 THEN (ip >> (32 - n)) * CAST(pow(2, 32 - n) AS BIGINT) END AS low, "
    "CASE WHEN n <= 32 THEN (ip >> (32 - n)) * CAST(pow(2, 32 - n) AS BIGINT) + CAST(pow(2, 32 - n) AS BIGINT) - 1 END AS high FROM c",
    "cidr_text",
    ctes={"c": CIDR},
)
case(
    "qualified_name",
    lambda t: t[TS].select(f.qualified_name("table_catalog", "table_schema", "table_name").alias("qualified_name")),
    f"SELECT concat(table_catalog, '.', table_schema, '.', table_name) AS qualified_name FROM {TS}",
    TS,
)
case(
    "safe_percent",
    lambda t: t[WH].select(
        "query_id", F.round(f.safe_percent("bytes_spilled_to_remote_storage", "execution_time"), 6).alias("percent")
    ),
    "SELECT query_id, round(CASE WHEN execution_time > 0 THEN bytes_spilled_to_remote_storage::DOUBLE / execution_time::DOUBLE * 100 "
    f"ELSE 0 END, 6) AS percent FROM {WH}",
    WH,
)
case(
    "safe_ratio",
    lambda t: t[WH].select("query_id", F.round(f.safe_ratio("queued_overload_time", "queued_provisioning_time"), 6).alias("ratio")),
    "SELECT query_id, round(CASE WHEN queued_provisioning_time > 0 THEN queued_overload_time::DOUBLE / queued_provisioning_time::DOUBLE "
    f"ELSE 0 END, 6) AS ratio FROM {WH}",
    WH,
)
case(
    "unit_conversions",
    lambda t: t[WH].select(
        "query_id",
        f.bytes_to_gb("bytes_spilled_to_local_storage").alias("gb"),
        f.ms_to_seconds("execution_time").alias("seconds"),
        f.seconds_to_hours("execution_time").alias("hours"),
        f.per_tb_to_per_gb("execution_time").alias("per_gb"),
    ),
    f"SELECT query_id, bytes_spilled_to_local_storage / {GB}::DOUBLE AS gb, execution_time / 1000.0::DOUBLE AS seconds, "
    f"execution_time / 3600.0::DOUBLE AS hours, execution_time / 1024.0::DOUBLE AS per_gb FROM {WH}",
    WH,
)
case(
    "default_label",
    lambda t: t["w_login_history"].select(
        f.default_label("reported_client_type", blank_too=True).alias("client_type"),
        f.default_label("first_authentication_factor").alias("first_factor"),
    ),
    "SELECT coalesce(nullif(reported_client_type, ''), 'Unknown') AS client_type, "
    "coalesce(first_authentication_factor, 'Unknown') AS first_factor FROM w_login_history",
    "w_login_history",
)
case(
    "yes_no_to_bool",
    lambda t: t["w_login_history"].select("is_success", f.yes_no_to_bool("is_success").alias("flag")),
    "SELECT is_success, upper(is_success) IN ('YES', 'TRUE') AS flag FROM w_login_history",
    "w_login_history",
)


def _options(t):
    tier, days = f.policy_options("options")
    return t["w_lifecycle"].select("options", tier.alias("archive_tier"), days.alias("archive_for_days"))


case(
    "policy_options",
    _options,
    "SELECT options, coalesce(json_extract_string(options, '$.ARCHIVE_TIER'), 'Unknown') AS archive_tier, "
    "coalesce(try_cast(json_extract_string(options, '$.ARCHIVE_FOR_DAYS') AS INT), 0) AS archive_for_days FROM w_lifecycle",
    "w_lifecycle",
)
_ROUTE = ("source_cloud", "source_region", "target_cloud", "target_region")
case(
    "cross_region_flag",
    lambda t: t[DT].select(*_ROUTE, f.cross_region_flag(*_ROUTE).alias("cross_region")),
    f"SELECT {', '.join(_ROUTE)}, source_cloud IS DISTINCT FROM target_cloud OR source_region IS DISTINCT FROM target_region "
    f"AS cross_region FROM {DT}",
    DT,
)
case(
    "is_compute_sku",
    lambda t: t["l_usage"].select("sku_name", f.is_compute_sku("sku_name").alias("is_compute")),
    "SELECT sku_name, contains(sku_name, 'COMPUTE') AS is_compute FROM l_usage",
    "l_usage",
)
case(
    "is_adjustment",
    lambda t: t[BL].select("usage_type", f.is_adjustment("usage_type").alias("is_adjustment")),
    f"SELECT usage_type, contains(lower(usage_type), 'adj') AS is_adjustment FROM {BL}",
    BL,
)
