"""Storage, automation, inventories, logins, AI usage."""

from fixtures.cases.access import LIVE, MANIFEST, SIZES, TS
from fixtures.cases.registry import E_SINCE, E_UNTIL, EV, GB, L_SINCE, L_UNTIL, LI, O_SINCE, O_UNTIL, OR, case, day
from meterlens.operators import ai_usage, automation, inventory, logins, ranking, storage
from meterlens.sources import job_names, live_files, table_sizes_from_files

# ---- expected labels, stated here on their own and not taken from the engine
VERBS = (
    "WHEN verb LIKE 'CALL%' THEN 'Stored Procedure Call' WHEN verb LIKE 'EXECUTE IMMEDIATE%' THEN 'EXECUTE IMMEDIATE' "
    "WHEN verb LIKE 'COPY%' THEN 'COPY INTO' WHEN verb SIMILAR TO '(MERGE|INSERT|UPDATE|DELETE|CREATE|ALTER|TRUNCATE).*' "
    "THEN regexp_extract(verb, '^[A-Z]+')"
)
TASKS_SEEN = (
    "WHEN 'notebook_task' THEN 'Notebook' WHEN 'sql_task' THEN 'SQL' WHEN 'spark_jar_task' THEN 'JAR' WHEN 'unknown_task' THEN 'Unknown'"
)

# ---- storage
case(
    "w_storage_summary",
    lambda t: storage.w_storage_summary(t[TS]),
    "SELECT "
    + ", ".join(
        f"CAST(sum({col}_bytes) AS BIGINT) / {GB}::DOUBLE AS total_{col}_gb"
        for col in ("active", "time_travel", "failsafe", "retained_for_clone")
    )
    + f" FROM {TS} WHERE NOT deleted",
    TS,
)
case(
    "w_top_tables",
    lambda t: storage.w_top_tables(t[TS]),
    f"SELECT qualified_name, bytes / {GB}::DOUBLE AS active_gb, tt / {GB}::DOUBLE AS time_travel_gb, fs / {GB}::DOUBLE AS failsafe_gb "
    "FROM live ORDER BY bytes DESC, qualified_name LIMIT 20",
    TS,
    ctes={"live": LIVE},
)
DS = "w_database_storage"
DS_DAILY = (
    f"SELECT usage_date, database_name, sum(average_database_bytes) AS bytes FROM {DS} "
    f"WHERE usage_date >= CAST({O_SINCE} AS DATE) AND usage_date < CAST({O_UNTIL} AS DATE) GROUP BY 1, 2"
)
LATEST = (
    "SELECT d.database_name, d.usage_date, round(d.bytes, 6) AS bytes FROM d JOIN ("
    "SELECT database_name, max(usage_date) AS usage_date FROM d GROUP BY 1) m USING (database_name, usage_date)"
)
case(
    "latest_snapshot",
    lambda t: ranking.latest_snapshot(
        t["w_billing"].filter(OR.date("usage_date")), "usage_type", "usage_date", "usage_in_currency"
    ),
    "SELECT b.usage_type, b.usage_date, round(sum(b.usage_in_currency), 6) AS usage_in_currency FROM w_billing b JOIN ("
    f"SELECT usage_type, max(usage_date) AS usage_date FROM w_billing WHERE usage_date >= CAST({O_SINCE} AS DATE) AND usage_date < CAST({O_UNTIL} AS DATE) GROUP BY 1) m "
    "ON b.usage_type = m.usage_type AND b.usage_date = m.usage_date GROUP BY 1, 2",
    "w_billing",
)
case(
    "w_database_storage_trend",
    lambda t: storage.w_database_storage_trend(t[DS], OR),
    f"SELECT {day('usage_date')} AS day, CASE WHEN database_name IN (SELECT database_name FROM top) THEN database_name ELSE 'Other' END "
    f"AS database_name, round(round(sum(bytes), 6) / {GB}::DOUBLE, 6) AS avg_gb FROM d GROUP BY 1, 2",
    DS,
    ctes={"d": DS_DAILY, "latest": LATEST, "top": "SELECT database_name FROM latest ORDER BY bytes DESC, database_name LIMIT 6"},
)
BEARING = (
    "SELECT concat(table_catalog, '.', table_schema, '.', table_name) AS qualified_name FROM l_tables "
    "WHERE table_type IN ('MANAGED', 'EXTERNAL', 'STREAMING_TABLE', 'MATERIALIZED_VIEW')"
)
SIZED = {"allsizes": SIZES, "bearing": BEARING, "sizes": "SELECT * FROM allsizes WHERE qualified_name IN (SELECT qualified_name FROM bearing)"}


def sizes(t):
    return table_sizes_from_files(t[MANIFEST], t["l_tables"])


# of each file the last action, an add before a remove of the same version
LIVE_FILES = (
    "SELECT qualified_name, format, path, coalesce(length, 0) AS length FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name, format, path "
    "ORDER BY version DESC, action, length DESC) AS n FROM l_table_log) WHERE n = 1 AND action = 'add'"
)
case("live_files", lambda t: live_files(t["l_table_log"]), "SELECT * FROM live", "l_table_log", ctes={"live": LIVE_FILES})
case(
    "table_sizes_from_log",
    lambda t: table_sizes_from_files(live_files(t["l_table_log"]), t["l_tables"]),
    "SELECT * FROM sizes",
    "l_table_log",
    "l_tables",
    ctes={"live": LIVE_FILES, "bearing": BEARING}
    | {"sizes": "SELECT qualified_name, format, count(*) AS num_files, CAST(sum(length) AS BIGINT) AS size_bytes FROM live "
       "WHERE qualified_name IN (SELECT qualified_name FROM bearing) GROUP BY 1, 2"},
)
case(
    "l_storage",
    lambda t: storage.l_storage(sizes(t)),
    "SELECT CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, count(*) AS tables_counted FROM sizes",
    MANIFEST,
    "l_tables",
    ctes=SIZED,
)
case(
    "l_largest_tables",
    lambda t: storage.l_largest_tables(sizes(t)),
    "SELECT * FROM sizes ORDER BY size_bytes DESC, qualified_name LIMIT 20",
    MANIFEST,
    "l_tables",
    ctes=SIZED,
)

# ---- automation
STATEMENT = (
    "CASE WHEN coalesce(trim(query_text), '') = '' THEN 'Unknown' "
    + VERBS.replace("verb", "upper(trim(query_text))")
    + " ELSE 'Other SQL' END"
)
TASKS = (
    f"SELECT task_name, arg_min({STATEMENT}, (scheduled_time, {STATEMENT})) AS task_type, count(*) AS total_runs, "
    "CAST(sum(CASE WHEN state = 'SUCCEEDED' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, "
    "CAST(sum(CASE WHEN state = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM w_task_history "
    f"WHERE scheduled_time >= {O_SINCE} AND scheduled_time < {O_UNTIL} GROUP BY 1"
)
case(
    "w_task_runs",
    lambda t: automation.w_task_runs(automation.w_task_rollup(t["w_task_history"], OR)),
    "SELECT * FROM tasks ORDER BY total_runs DESC, task_name LIMIT 20",
    "w_task_history",
    ctes={"tasks": TASKS},
)
case(
    "w_pipe_ingest",
    lambda t: automation.w_pipe_ingest(t["w_pipe_usage"], LI),
    "SELECT pipe_name, round(coalesce(sum(credits_used), 0), 6) AS total_credits, "
    f"CAST(sum(files_inserted) AS BIGINT) AS total_files_inserted, CAST(sum(bytes_inserted) AS BIGINT) / {GB}::DOUBLE AS total_bytes_inserted_gb "
    f"FROM w_pipe_usage WHERE start_time >= {L_SINCE} AND start_time < {L_UNTIL} GROUP BY 1 ORDER BY total_credits DESC, pipe_name LIMIT 20",
    "w_pipe_usage",
)
case(
    "w_streams_summary",
    lambda t: automation.w_streams_summary(t["w_streams"]),
    "SELECT count(*) AS total_streams, CAST(sum(CASE WHEN lower(stale) = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS stale_streams FROM w_streams",
    "w_streams",
)
case(
    "w_mv_refresh",
    lambda t: automation.w_mv_refresh(t["w_mv_refresh"], LI),
    "SELECT view_name, count(*) AS total_refreshes, round(sum(credits_used), 6) AS total_credits, "
    "round(sum(epoch_ms(end_time) - epoch_ms(start_time))::DOUBLE / 1000.0 / count(*), 6) AS avg_duration_seconds "
    f"FROM w_mv_refresh WHERE start_time >= {L_SINCE} AND start_time < {L_UNTIL} GROUP BY 1 ORDER BY total_refreshes DESC, view_name LIMIT 20",
    "w_mv_refresh",
)
case(
    "w_replication_usage",
    lambda t: automation.w_replication_usage(t["w_replication"], LI),
    "SELECT replication_group_name, round(sum(credits_used), 6) AS total_credits, "
    "CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes_transferred, count(*) AS event_count "
    f"FROM w_replication WHERE start_time >= {L_SINCE} AND start_time < {L_UNTIL} GROUP BY 1",
    "w_replication",
)
JR = "l_job_runs"
JOB_ROLL = (
    "SELECT job_id, count(*) AS total_runs, CAST(sum(CASE WHEN result_state = 'SUCCEEDED' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, "
    "CAST(sum(CASE WHEN result_state IS NULL OR result_state <> 'SUCCEEDED' THEN 1 ELSE 0 END) AS BIGINT) AS failed, "
    "avg(execution_duration_seconds) AS avg_s, CAST(sum(execution_duration_seconds) AS BIGINT) AS total_s "
    f"FROM {JR} WHERE period_start_time >= {O_SINCE} AND period_start_time < {O_UNTIL} GROUP BY 1"
)
TOP_JOBS = "SELECT * FROM jr ORDER BY total_runs DESC, job_id LIMIT 20"


def job_rollup(t):
    return automation.l_job_rollup(t[JR], OR)


case(
    "l_job_runs",
    lambda t: automation.l_job_runs(job_rollup(t), job_names(t["l_jobs"])),
    "SELECT top.job_id, coalesce(n.name, top.job_id) AS job_name, total_runs, succeeded, failed, "
    "round(avg_s, 6) AS avg_duration_seconds, total_s / 3600.0::DOUBLE AS total_hours FROM top "
    "LEFT JOIN (SELECT job_id, name FROM l_jobs WHERE delete_time IS NULL) n ON top.job_id = n.job_id",
    JR,
    "l_jobs",
    ctes={"jr": JOB_ROLL, "top": TOP_JOBS},
)
JOB_TOTALS = (
    "SELECT count(*) AS distinct_jobs_run, CAST(sum(total_runs) AS BIGINT) AS total_runs, "
    "CAST(sum(total_s) AS BIGINT) / 3600.0::DOUBLE AS total_run_hours, "
    "round(sum(succeeded)::DOUBLE / sum(total_runs)::DOUBLE * 100, 6) AS success_rate_percent FROM jr"
)
case("l_job_totals", lambda t: automation.l_job_totals(job_rollup(t)), JOB_TOTALS, JR, ctes={"jr": JOB_ROLL})
case(
    "l_daily_job_runs",
    lambda t: automation.l_daily_job_runs(t[JR], OR),
    f"SELECT {day('period_start_time')} AS day, count(*) AS total_runs, "
    "CAST(sum(CASE WHEN result_state = 'SUCCEEDED' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded "
    f"FROM {JR} WHERE period_start_time >= {O_SINCE} AND period_start_time < {O_UNTIL} GROUP BY 1",
    JR,
)
TASK_ROWS = (
    "SELECT job_id, coalesce(json_extract_string(task, '$.task_key'), '') AS task_key, "
    "coalesce(list_filter(json_keys(task), lambda k: k LIKE '%\\_task' ESCAPE '\\')[1], 'unknown_task') AS task_type FROM ("
    "SELECT job_id, unnest(CASE WHEN json_valid(payload) THEN json_extract(payload, '$.settings.tasks[*]') END) AS task FROM l_job_payloads)"
)
FRIENDLY = (
    "CASE task_type " + TASKS_SEEN + " ELSE array_to_string("
    "list_transform(string_split(regexp_replace(task_type, '_task$', ''), '_'), lambda w: upper(w[1]) || w[2:]), ' ') END"
)
case(
    "l_task_types",
    lambda t: automation.l_task_types(t["l_job_payloads"], job_rollup(t)),
    f"SELECT {FRIENDLY} AS task_type, count(*) AS count FROM tasks WHERE job_id IN (SELECT job_id FROM jr) GROUP BY 1",
    JR,
    "l_job_payloads",
    ctes={"jr": JOB_ROLL, "tasks": TASK_ROWS},
)

# ---- inventories
KINDS = ("Databases", "Schemas", "Tables", "Views", "Stored Procedures", "Functions")
OBJECTS = " UNION ALL ".join(
    f"SELECT '{k}' AS object_type, count(*) AS count FROM w_objects WHERE deleted IS NULL AND object_type = '{k}'" for k in KINDS
)
case("w_object_inventory", lambda t: inventory.w_object_inventory(t["w_objects"]), OBJECTS, "w_objects")
case(
    "w_shares_summary",
    lambda t: inventory.w_shares_summary(t["w_shares"]),
    "SELECT count(*) AS total_shares, CAST(sum(CASE WHEN upper(kind) = 'OUTBOUND' THEN 1 ELSE 0 END) AS BIGINT) AS outbound_shares, "
    "CAST(sum(CASE WHEN upper(kind) = 'INBOUND' THEN 1 ELSE 0 END) AS BIGINT) AS inbound_shares FROM w_shares",
    "w_shares",
)
case(
    "w_shares_list",
    lambda t: inventory.w_shares_list(t["w_shares"]),
    "SELECT name AS share_name, kind, database_name, to_list AS to_accounts FROM w_shares",
    "w_shares",
)
DT = "w_data_transfer"
case(
    "w_data_transfer",
    lambda t: inventory.w_data_transfer(t[DT], LI),
    "SELECT transfer_type, source_cloud, source_region, target_cloud, target_region, "
    "source_cloud IS DISTINCT FROM target_cloud OR source_region IS DISTINCT FROM target_region AS cross_region, "
    f"bytes / {GB}::DOUBLE AS total_gb FROM ("
    "SELECT transfer_type, source_cloud, source_region, target_cloud, target_region, CAST(sum(bytes_transferred) AS BIGINT) AS bytes "
    f"FROM {DT} WHERE start_time >= {L_SINCE} AND start_time < {L_UNTIL} GROUP BY ALL) ORDER BY bytes DESC, transfer_type, source_cloud, source_region, "
    "target_cloud NULLS FIRST, target_region LIMIT 20",
    DT,
)
case(
    "w_data_transfer_total",
    lambda t: inventory.w_data_transfer_total(t[DT], LI),
    f"SELECT CAST(sum(bytes_transferred) AS BIGINT) / {GB}::DOUBLE AS total_gb FROM {DT} WHERE start_time >= {L_SINCE} AND start_time < {L_UNTIL}",
    DT,
)
POLICIES = (
    "SELECT name AS policy_name, database_name, schema_name, coalesce(json_extract_string(options, '$.ARCHIVE_TIER'), 'Unknown') AS archive_tier, "
    "coalesce(try_cast(json_extract_string(options, '$.ARCHIVE_FOR_DAYS') AS INT), 0) AS archive_for_days "
    "FROM w_lifecycle WHERE deleted_on IS NULL"
)
case("w_lifecycle_policies", lambda t: inventory.w_lifecycle_policies(t["w_lifecycle"]), POLICIES, "w_lifecycle")
case(
    "w_lifecycle_policy_count",
    lambda t: inventory.w_lifecycle_policy_count(t["w_lifecycle"]),
    "SELECT count(*) AS policy_count FROM w_lifecycle WHERE deleted_on IS NULL",
    "w_lifecycle",
)
L_OBJECTS = "SELECT table_type, count(*) AS object_count FROM l_tables GROUP BY 1"
case("l_object_inventory", lambda t: inventory.l_object_inventory(t["l_tables"]), L_OBJECTS, "l_tables")
CATALOGS = (
    "SELECT 'CATALOG' AS object_type, count(*) AS object_count FROM l_catalogs UNION ALL "
    "SELECT 'SCHEMA', count(*) FROM l_schemata"
)
case(
    "l_catalog_schema_counts",
    lambda t: inventory.l_catalog_schema_counts(t["l_catalogs"], t["l_schemata"]),
    CATALOGS,
    "l_catalogs",
    "l_schemata",
)

# ---- logins
LOGINS = "w_login_history"
E_RECENT = f"event_timestamp >= {E_SINCE} AND event_timestamp < {E_UNTIL}"
BASE_CLIENT = (
    "CASE WHEN coalesce(trim(client_application_id), '') = '' THEN 'Unknown' "
    "ELSE regexp_replace(trim(client_application_id), '\\s+v?[0-9][0-9a-zA-Z.\\-]*$', '') END"
)
case(
    "w_sessions_by_client",
    lambda t: logins.w_sessions_by_client(t["w_sessions"], EV),
    f"SELECT {BASE_CLIENT} AS client_application_id, count(*) AS session_count FROM w_sessions WHERE created_on >= {E_SINCE} AND created_on < {E_UNTIL} GROUP BY 1",
    "w_sessions",
)
OCTETS = "string_split({0}, '.')"
IP_LONG = (
    "CASE WHEN regexp_full_match({0}, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') AND "
    + " AND ".join(f"CAST(string_split({{0}}, '.')[{i}] AS INT) <= 255" for i in range(1, 5))
    + " THEN ((CAST(string_split({0}, '.')[1] AS BIGINT) * 256 + CAST(string_split({0}, '.')[2] AS BIGINT)) * 256 "
    "+ CAST(string_split({0}, '.')[3] AS BIGINT)) * 256 + CAST(string_split({0}, '.')[4] AS BIGINT) END"
)
BY_IP = f"SELECT client_ip, count(*) AS login_count FROM {LOGINS} WHERE {E_RECENT} GROUP BY 1"
# every address against every range, in list order
RANGES = (
    f"SELECT channel, priority, {IP_LONG.format('split_part(cidr, chr(47), 1)')} AS ip, "
    "CASE WHEN contains(cidr, '/') THEN CAST(split_part(cidr, '/', 2) AS INT) ELSE 32 END AS n FROM network_policies"
)
CHANNELS = (
    "SELECT client_ip, login_count, CASE WHEN client_ip IS NULL OR client_ip = '' THEN 'Unknown' ELSE coalesce(("
    f"SELECT arg_min(channel, priority) FROM ranges WHERE addr >> (32 - n) = ip >> (32 - n)), 'Unmatched') END AS channel "
    f"FROM (SELECT *, {IP_LONG.format('client_ip')} AS addr FROM by_ip)"
)
LOGIN_CTES = {"by_ip": BY_IP, "ranges": RANGES, "ch": CHANNELS}
LOGIN_VIEWS = (LOGINS, "network_policies")


def channels(t):
    return logins.login_channel(logins.logins_by_ip(t[LOGINS], EV), t["network_policies"])


BY_CHANNEL = "SELECT channel, CAST(sum(login_count) AS BIGINT) AS login_count FROM ch GROUP BY 1"
BY_CLIENT = (
    f"SELECT coalesce(nullif(reported_client_type, ''), 'Unknown') AS client_type, count(*) AS login_count FROM {LOGINS} "
    f"WHERE {E_RECENT} GROUP BY 1"
)
case("login_channel", channels, "SELECT client_ip, channel, login_count FROM ch", *LOGIN_VIEWS, ctes=LOGIN_CTES)
case("w_logins_by_channel", lambda t: logins.w_logins_by_channel(channels(t)), BY_CHANNEL, *LOGIN_VIEWS, ctes=LOGIN_CTES)
case("w_logins_by_client_type", lambda t: logins.w_logins_by_client_type(t[LOGINS], EV), BY_CLIENT, LOGINS)
case(
    "w_login_total",
    lambda t: logins.w_login_total(t[LOGINS], EV),
    f"SELECT count(*) AS total_logins FROM {LOGINS} WHERE {E_RECENT}",
    LOGINS,
)
case(
    "login_shares",
    lambda t: logins.login_shares(
        logins.w_logins_by_channel(channels(t)), logins.w_logins_by_client_type(t[LOGINS], EV), "vpn", "purchase"
    ),
    "SELECT (SELECT round(sum(CASE WHEN channel = 'vpn' THEN login_count ELSE 0 END)::DOUBLE / sum(login_count)::DOUBLE * 100, 6) FROM bc) "
    "AS channel_percent, (SELECT round(sum(CASE WHEN client_type = 'purchase' THEN login_count ELSE 0 END)::DOUBLE "
    "/ sum(login_count)::DOUBLE * 100, 6) FROM bt) AS client_type_percent",
    *LOGIN_VIEWS,
    ctes=LOGIN_CTES | {"bc": BY_CHANNEL, "bt": BY_CLIENT},
)
case(
    "w_auth_factors",
    lambda t: logins.w_auth_factors(t[LOGINS], EV),
    "SELECT coalesce(first_authentication_factor, 'Unknown') AS first_factor, second_authentication_factor AS second_factor, "
    f"upper(is_success) = 'YES' AS is_success, count(*) AS login_count FROM {LOGINS} WHERE {E_RECENT} GROUP BY 1, 2, 3",
    LOGINS,
)

# ---- AI and ML
MLFLOW = (
    "SELECT (SELECT count(*) FROM l_experiments WHERE delete_time IS NULL) AS total_experiments, count(*) AS total_runs, "
    "CAST(sum(CASE WHEN status = 'FINISHED' THEN 1 ELSE 0 END) AS BIGINT) AS finished_runs FROM l_runs "
    f"WHERE start_time >= {E_SINCE} AND start_time < {E_UNTIL}"
)
case("l_mlflow_summary", lambda t: ai_usage.l_mlflow_summary(t["l_experiments"], t["l_runs"], EV), MLFLOW, "l_experiments", "l_runs")
case(
    "scalar_subquery",
    lambda t: ai_usage.scalar_subquery(
        ai_usage.l_serving_usage(t["l_endpoint_usage"], EV), policies=inventory.w_lifecycle_policy_count(t["w_lifecycle"])
    ),
    "SELECT (SELECT count(*) FROM w_lifecycle WHERE deleted_on IS NULL) AS policies, count(*) AS total_requests, "
    "CAST(sum(coalesce(input_token_count, 0) + coalesce(output_token_count, 0)) AS BIGINT) AS total_tokens "
    f"FROM l_endpoint_usage WHERE request_time >= {E_SINCE} AND request_time < {E_UNTIL}",
    "l_endpoint_usage",
    "w_lifecycle",
)
case(
    "l_serving_endpoints",
    lambda t: ai_usage.l_serving_endpoints(t["l_served_entities"]),
    "SELECT entity_type, count(*) AS count FROM l_served_entities WHERE endpoint_delete_time IS NULL GROUP BY 1",
    "l_served_entities",
)
case(
    "l_serving_endpoint_total",
    lambda t: ai_usage.l_serving_endpoint_total(ai_usage.l_serving_endpoints(t["l_served_entities"])),
    "SELECT count(*) AS active_serving_endpoints FROM l_served_entities WHERE endpoint_delete_time IS NULL",
    "l_served_entities",
)
case(
    "l_serving_usage",
    lambda t: ai_usage.l_serving_usage(t["l_endpoint_usage"], EV),
    "SELECT count(*) AS total_requests, CAST(sum(coalesce(input_token_count, 0) + coalesce(output_token_count, 0)) AS BIGINT) AS total_tokens "
    f"FROM l_endpoint_usage WHERE request_time >= {E_SINCE} AND request_time < {E_UNTIL}",
    "l_endpoint_usage",
)
GATEWAY = (
    "SELECT coalesce(destination_type, 'UNKNOWN') AS destination_type, coalesce(destination_name, 'UNKNOWN') AS destination_name, "
    "count(*) AS request_count, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS total_tokens "
    f"FROM l_gateway_usage g WHERE event_time >= {E_SINCE} AND event_time < {E_UNTIL} GROUP BY 1, 2"
)
case("l_ai_gateway", lambda t: ai_usage.l_ai_gateway(t["l_gateway_usage"], EV), GATEWAY, "l_gateway_usage")
case(
    "l_ai_gateway_totals",
    lambda t: ai_usage.l_ai_gateway_totals(ai_usage.l_ai_gateway(t["l_gateway_usage"], EV)),
    "SELECT count(*) AS request_count, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS total_tokens "
    f"FROM l_gateway_usage WHERE event_time >= {E_SINCE} AND event_time < {E_UNTIL}",
    "l_gateway_usage",
)
case(
    "l_quality_monitoring",
    lambda t: ai_usage.l_quality_monitoring(t["l_quality_results"], EV),
    "SELECT count(DISTINCT table_id) AS tables_monitored, count(*) AS check_runs, "
    "CAST(sum(CASE WHEN status = 'Healthy' THEN 1 ELSE 0 END) AS BIGINT) AS healthy_runs, "
    "round(sum(CASE WHEN status = 'Healthy' THEN 1 ELSE 0 END)::DOUBLE / count(*) * 100, 6) AS healthy_percent "
    f"FROM l_quality_results WHERE event_time >= {E_SINCE} AND event_time < {E_UNTIL}",
    "l_quality_results",
)
case(
    "l_classification",
    lambda t: ai_usage.l_classification(t["l_classification"]),
    "SELECT count(*) AS total_results, count(DISTINCT table_id) AS tables_classified FROM l_classification",
    "l_classification",
)
