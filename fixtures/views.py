"""Raw usage tables built row by row from the driver tables.

Each view is one SELECT over one source table, written once as text that both
Spark and DuckDB accept, so the oracle and the engine read the same rows.
``NEST`` adds the struct and array columns on the Spark side; the oracle reads
the flat columns instead.  No view joins, collects or groups its source (the
user list is a DISTINCT), so a registered query measures the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# every source has rows before and after its window
EVENTS_AS_OF, EVENTS_DAYS = "2024-01-26", 20
ORDERS_AS_OF, ORDERS_DAYS = "2001-06-15", 365
LINEITEM_AS_OF, LINEITEM_DAYS = "2001-09-15", 365
DOMAIN = "corp.example"
EMPLOYEES = "Employees"
ACCOUNT, CURRENCY = "AC1", "USD"


@dataclass(frozen=True)
class View:
    source: str
    columns: dict[str, str]
    distinct: bool = False

    def sql(self) -> str:
        source = self.source
        if source.startswith("range"):
            source = f"{source} AS t(id)"
        cols = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        return f"SELECT {'DISTINCT ' if self.distinct else ''}{cols} FROM {source}"


K = "CAST(regexp_extract(props,'([0-9]+)',1) AS INT)"


def _user(uid: str, service: str) -> str:
    return (
        f"WHEN {uid}%4=0 THEN concat('{service}',{uid}) "
        f"WHEN {uid}%4=1 THEN concat('user',{uid},'@partner.example') "
        f"ELSE concat('User',{uid},'@corp.example') END"
    )


_STATUS = "CASE WHEN event_type='error' THEN 'FAILED' WHEN {K}=50 THEN NULL ELSE '{ok}' END"
_DURATION = "CASE WHEN event_type='signup' THEN 0 ELSE CAST(round(value*1000) AS BIGINT) END"
_MESSAGE = (
    f"CASE WHEN event_type<>'error' THEN NULL WHEN {K}%11=0 THEN NULL "
    f"WHEN {K}%5=0 THEN concat('plain failure ',event_id) "
    f"ELSE concat('[CLASS_',{K}%5,'] object ',event_id) END"
)
_SPILL = "CASE WHEN value>50 THEN CAST(round(value*1000000) AS BIGINT) ELSE 0 END"
_QUEUED = f"CAST(CASE WHEN {K}>90 THEN {K}*1000 ELSE 0 END AS BIGINT)"
_ACTOR_E = f"CASE WHEN {K}=99 THEN NULL " + _user("user_id", "uuid-")
_ACTOR_L = (
    "CASE WHEN l_suppkey%29=0 THEN NULL WHEN l_suppkey%2=0 THEN concat('uuid-',l_suppkey) "
    "WHEN l_suppkey%3=0 THEN concat('person',l_suppkey,'@partner.example') "
    "ELSE concat('User',l_suppkey,'@Corp.Example') END"
)


def _w_object(key: str) -> str:
    upper = f"concat('DB_',{key}%7,'.S_',{key}%3,'.T',{key})"
    return f"CASE WHEN l_linenumber=1 THEN lower({upper}) ELSE {upper} END"


def _l_table(key: str, name: str = "t") -> str:
    return f"concat('cat',{key}%5,'.s',{key}%3,'.{name}',{key})"


_STATEMENTS = (
    "CASE (o_custkey+o_orderkey)%13 WHEN 0 THEN 'CALL nightly()' WHEN 1 THEN '  execute immediate stmt' "
    "WHEN 2 THEN 'merge into t' WHEN 3 THEN 'INSERT INTO t' WHEN 4 THEN 'Update t' WHEN 5 THEN 'delete from t' "
    "WHEN 6 THEN 'COPY INTO t' WHEN 7 THEN 'create table t' WHEN 8 THEN 'alter table t' WHEN 9 THEN ' TRUNCATE t' "
    "WHEN 10 THEN 'SELECT 1' WHEN 11 THEN NULL ELSE '   ' END"
)
_PAYLOAD_TASKS = (
    "CASE c_custkey%6 WHEN 0 THEN concat('{\"settings\":{\"tasks\":[{\"task_key\":\"a',c_custkey,'\",\"notebook_task\":{\"p\":1}},"
    "{\"task_key\":\"b\",\"sql_task\":{}}]}}') "
    "WHEN 1 THEN '{\"settings\":{\"tasks\":[{\"task_key\":\"m\",\"spark_jar_task\":{}}]}}' "
    "WHEN 2 THEN '{\"settings\":{\"tasks\":[' "
    "WHEN 3 THEN '{\"settings\":{\"tasks\":[{\"task_key\":\"n\",\"depends_on\":[]}]}}' "
    "WHEN 4 THEN '{\"settings\":{\"tasks\":[{\"task_key\":\"q\",\"clean_rooms_notebook_task\":{}}]}}' "
    "ELSE '{\"settings\":{}}' END"
)

VIEWS: dict[str, View] = {
    # ---- warehouse side -------------------------------------------------
    "w_users": View(
        "events",
        {
            "user_name": "CASE " + _user("user_id", "svc_"),
            "user_type": "CASE user_id%4 WHEN 0 THEN 'SERVICE' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'PERSON' END",
            "disabled": "user_id%10=0",
            "deleted_on": "CASE WHEN user_id%37=0 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) END",
        },
        distinct=True,
    ),
    "w_query_history": View(
        "events",
        {
            "query_id": "CAST(event_id AS STRING)",
            "start_time": "ts",
            "user_name": f"CASE WHEN {K}=99 THEN NULL " + _user("user_id", "svc_"),
            "database_name": f"CASE WHEN {K}%10=0 THEN NULL ELSE concat('DB_',user_id%11) END",
            "warehouse_name": f"CASE WHEN {K}%13=0 THEN NULL ELSE concat('WH_',user_id%20) END",
            "execution_status": _STATUS.format(K=K, ok="SUCCESS"),
            "execution_time": _DURATION,
            "error_code": f"CASE WHEN event_type='error' AND {K}%7<>0 THEN concat('E',{K}%7) END",
            "error_message": _MESSAGE,
            "bytes_spilled_to_local_storage": _SPILL,
            "bytes_spilled_to_remote_storage": "CASE WHEN value>100 THEN CAST(round(value*1000) AS BIGINT) ELSE 0 END",
            "queued_provisioning_time": _QUEUED,
            "queued_overload_time": f"CAST(CASE WHEN {K}>95 THEN 500 ELSE 0 END AS BIGINT)",
        },
    ),
    "w_metering": View(
        "events",
        {"warehouse_name": "concat('WH_',user_id%20)", "start_time": "ts", "credits_used": "round(value/100,4)"},
    ),
    "w_attribution": View(
        "events",
        {
            "user_name": "CASE " + _user("user_id", "svc_"),
            "start_time": "ts",
            "credits_attributed_compute": "value/200",
        },
    ),
    "w_login_history": View(
        "events",
        {
            "event_timestamp": "ts",
            "client_ip": f"CASE WHEN {K}=0 THEN NULL WHEN {K}=1 THEN '' WHEN {K}=2 THEN 'not-an-ip' "
            f"WHEN {K}=3 THEN '10.0.0.256' ELSE concat('10.',user_id%4,'.',{K}%8,'.',event_id%250) END",
            "reported_client_type": "CASE WHEN event_type='view' THEN NULL WHEN event_type='click' THEN '' ELSE event_type END",
            "first_authentication_factor": f"CASE {K}%3 WHEN 0 THEN 'PASSWORD' WHEN 1 THEN 'KEY_PAIR' END",
            "second_authentication_factor": f"CASE WHEN {K}%2=1 THEN 'MFA' END",
            "is_success": "CASE WHEN event_type='error' THEN 'NO' WHEN event_type='view' THEN 'Yes' ELSE 'YES' END",
        },
    ),
    "w_sessions": View(
        "events",
        {
            "client_application_id": f"CASE {K}%6 WHEN 0 THEN NULL WHEN 1 THEN concat('JDBC 3.',{K}) "
            f"WHEN 2 THEN concat('Driver v',{K},'.1-b2') WHEN 3 THEN ' WebUI ' WHEN 4 THEN '  ' ELSE 'SQL API' END",
            "created_on": "ts",
        },
    ),
    "w_access_history": View(
        "lineitem",
        {
            "query_id": "CAST(l_orderkey AS STRING)",
            "user_name": "CASE " + _user("(l_orderkey%148)", "svc_"),
            "query_start_time": "l_shipdate",
            "read_name": _w_object("(l_partkey-l_partkey%2)"),
            "read_domain": "CASE WHEN l_linenumber=7 THEN 'View' ELSE 'Table' END",
            "read_name_2": _w_object("(l_suppkey*2)"),
            "has_reads": "l_linenumber<>4",
            "write_name": f"CASE WHEN l_returnflag='R' THEN {_w_object('(l_partkey-l_partkey%2)')} END",
        },
    ),
    "w_table_storage": View(
        "part",
        {
            "table_catalog": "CASE WHEN p_partkey%3=0 THEN concat('db_',p_partkey%7) ELSE concat('DB_',p_partkey%7) END",
            "table_schema": "concat('S_',p_partkey%3)",
            "table_name": "concat('T',p_partkey)",
            "active_bytes": "CASE WHEN p_partkey%23=0 THEN NULL ELSE CAST(p_size AS BIGINT)*1048576*(p_partkey+1) END",
            "time_travel_bytes": "CAST(p_size AS BIGINT)*52428*(p_partkey+1)",
            "failsafe_bytes": "CAST(p_size AS BIGINT)*1024*(p_partkey+1)",
            "retained_for_clone_bytes": "CAST(p_size AS BIGINT)*4096",
            "deleted": "p_partkey%19=0",
        },
    ),
    "w_database_storage": View(
        "orders",
        {
            "usage_date": "CAST(o_orderdate AS DATE)",
            "database_name": "CASE WHEN o_custkey%9=3 AND o_orderdate>=CAST('2001-07-01' AS TIMESTAMP) THEN 'DB_4' "
            "ELSE concat('DB_',o_custkey%9) END",
            "average_database_bytes": "o_totalprice*1000000",
        },
    ),
    "w_billing": View(
        "orders",
        {
            "usage_date": "CAST(o_orderdate AS DATE)",
            "account_locator": "CASE WHEN o_orderkey%5=0 THEN 'AC2' ELSE 'AC1' END",
            "currency": "CASE WHEN o_orderkey%11=0 THEN 'EUR' ELSE 'USD' END",
            "usage_type": "CASE WHEN o_orderpriority='5-LOW' THEN 'Adj for incl cloud services' "
            "WHEN o_orderpriority='1-URGENT' THEN 'compute' ELSE concat('usage ',o_custkey%11) END",
            "usage_in_currency": "CASE WHEN o_orderpriority='5-LOW' THEN -o_totalprice/1000 ELSE o_totalprice/1000 END",
        },
    ),
    "w_task_history": View(
        "orders",
        {
            "task_name": "concat('TASK_',o_custkey%30)",
            "database_name": "concat('DB_',o_custkey%9)",
            "schema_name": "'S'",
            "state": "CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'FAILED' ELSE 'SKIPPED' END",
            "scheduled_time": "o_orderdate",
            "query_text": _STATEMENTS,
        },
    ),
    "w_pipe_usage": View(
        "lineitem",
        {
            "pipe_name": "concat('PIPE_',l_suppkey)",
            "start_time": "l_shipdate",
            "credits_used": "CASE WHEN l_linenumber=5 THEN NULL ELSE l_tax END",
            "bytes_inserted": "CAST(floor(l_extendedprice) AS BIGINT)*1000",
            "files_inserted": "CAST(l_linenumber AS BIGINT)",
        },
    ),
    "w_mv_refresh": View(
        "lineitem",
        {
            "view_name": "concat('MV_',l_suppkey)",
            "database_name": "concat('DB_',l_suppkey%7)",
            "schema_name": "'S'",
            "start_time": "l_shipdate",
            "end_time": "l_shipdate + INTERVAL '1' SECOND * CAST(l_quantity AS INT)",
            "credits_used": "l_discount",
        },
    ),
    "w_data_transfer": View(
        "lineitem",
        {
            "start_time": "l_shipdate",
            "source_cloud": "'aws'",
            "source_region": "concat('us-',l_suppkey%3)",
            "target_cloud": "CASE WHEN l_suppkey%11=0 THEN NULL WHEN l_suppkey%2=0 THEN 'aws' ELSE 'azure' END",
            "target_region": "concat('us-',l_suppkey%2)",
            "transfer_type": "CASE l_returnflag WHEN 'A' THEN 'COPY' WHEN 'N' THEN 'REPLICATION' ELSE 'EXTERNAL_FUNCTION' END",
            "bytes_transferred": "CAST(floor(l_extendedprice) AS BIGINT)*1000",
        },
    ),
    "w_replication": View(
        "lineitem",
        {
            "replication_group_name": "concat('RG_',l_suppkey%25)",
            "start_time": "l_shipdate",
            "credits_used": "l_discount",
            "bytes_transferred": "CAST(floor(l_extendedprice) AS BIGINT)",
        },
    ),
    "w_objects": View(
        "customer",
        {
            "object_type": "CASE c_custkey%7 WHEN 0 THEN 'Databases' WHEN 1 THEN 'Schemas' WHEN 2 THEN 'Tables' "
            "WHEN 3 THEN 'Views' WHEN 4 THEN 'Stored Procedures' WHEN 5 THEN 'Functions' ELSE 'Sequences' END",
            "deleted": "CASE WHEN c_custkey%5=0 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) END",
        },
    ),
    "w_streams": View(
        "supplier",
        {
            "name": "concat('STREAM_',s_suppkey)",
            "database_name": "concat('DB_',s_suppkey%7)",
            "schema_name": "'S'",
            "stale": "CASE s_suppkey%4 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'false' END",
        },
    ),
    "w_shares": View(
        "customer",
        {
            "name": "concat('SHARE_',c_custkey)",
            "kind": "CASE c_custkey%4 WHEN 0 THEN 'OUTBOUND' WHEN 1 THEN 'inbound' WHEN 2 THEN 'Inbound' END",
            "database_name": "concat('DB_',c_custkey%7)",
            "to_list": "CASE WHEN c_custkey%4=0 THEN concat('ACCT_',c_nationkey) END",
        },
    ),
    "w_lifecycle": View(
        "supplier",
        {
            "name": "concat('POLICY_',s_suppkey)",
            "database_name": "concat('DB_',s_suppkey%7)",
            "schema_name": "'S'",
            "options": "CASE s_suppkey%4 WHEN 0 THEN concat('{\"ARCHIVE_TIER\":\"COLD\",\"ARCHIVE_FOR_DAYS\":',s_suppkey,'}') "
            "WHEN 1 THEN '{\"ARCHIVE_TIER\":\"COOL\"}' WHEN 2 THEN '{\"ARCHIVE_FOR_DAYS\":\"30\",\"OTHER\":1}' END",
            "deleted_on": "CASE WHEN s_suppkey%5=0 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) END",
        },
    ),
    "network_policies": View(
        "range(4)",
        {
            "channel": "CASE id WHEN 0 THEN 'vpn' WHEN 1 THEN 'bi' WHEN 2 THEN 'etl' ELSE 'host' END",
            "cidr": "CASE id WHEN 0 THEN '10.0.0.0/24' WHEN 1 THEN '10.1.0.0/22' WHEN 2 THEN '10.0.0.0/22' ELSE '10.2.3.4' END",
            "priority": "CAST(id AS INT)",
        },
    ),
    # ---- lakehouse side -------------------------------------------------
    "l_usage": View(
        "lineitem",
        {
            "usage_date": "CAST(l_shipdate AS DATE)",
            "usage_start_time": "l_shipdate",
            "sku_name": "concat('SKU_',l_partkey%12,CASE WHEN l_partkey%3=0 THEN '_COMPUTE' ELSE '' END)",
            "billing_origin_product": "l_returnflag",
            "usage_quantity": "l_quantity",
            "run_as": "CASE WHEN l_suppkey%7=0 THEN NULL ELSE " + _ACTOR_L + " END",
        },
    ),
    # 11 of the 12 SKUs carry a price, in two periods that meet at 2001-05-01.
    "l_list_prices": View(
        "range(22)",
        {
            "sku_name": "concat('SKU_',CASE WHEN id%11>=5 THEN id%11+1 ELSE id%11 END,"
            "CASE WHEN (CASE WHEN id%11>=5 THEN id%11+1 ELSE id%11 END)%3=0 THEN '_COMPUTE' ELSE '' END)",
            "price_start_time": "CASE WHEN id<11 THEN CAST('1990-01-01 00:00:00' AS TIMESTAMP) ELSE CAST('2001-05-01 00:00:00' AS TIMESTAMP) END",
            "price_end_time": "CASE WHEN id<11 THEN CAST('2001-05-01 00:00:00' AS TIMESTAMP) END",
            "price": "CAST(CASE WHEN id<11 THEN 0.25 ELSE 0.5 END AS DOUBLE)",
        },
    ),
    "l_query_history": View(
        "events",
        {
            "start_time": "ts",
            "executed_by": _ACTOR_E,
            "compute_type": "CASE user_id%3 WHEN 0 THEN 'WAREHOUSE' WHEN 1 THEN 'CLUSTER' ELSE 'SERVERLESS_COMPUTE' END",
            "warehouse_id": "CASE WHEN user_id%3=0 THEN concat('w',user_id%20) END",
            "cluster_id": "CASE WHEN user_id%3=1 THEN concat('c',user_id%15) END",
            "execution_status": _STATUS.format(K=K, ok="FINISHED"),
            "error_message": _MESSAGE,
            "total_duration_ms": _DURATION,
            "spilled_local_bytes": _SPILL,
            "waiting_for_compute_duration_ms": _QUEUED,
        },
    ),
    "l_audit": View(
        "events",
        {
            "event_date": "CAST(ts AS DATE)",
            "event_time": "ts",
            "service_name": "event_type",
            "email": _ACTOR_E,
        },
    ),
    "l_lineage": View(
        "lineitem",
        {
            "event_date": "CAST(l_shipdate AS DATE)",
            "created_by": _ACTOR_L,
            "source_table_full_name": f"CASE WHEN l_returnflag='N' THEN NULL ELSE {_l_table('l_partkey')} END",
            "source_table_schema": "CASE l_linenumber WHEN 6 THEN '__internal' WHEN 5 THEN NULL ELSE concat('s',l_partkey%3) END",
            "target_table_full_name": f"CASE WHEN l_returnflag='A' THEN NULL ELSE {_l_table('l_suppkey', 'x')} END",
            "target_table_schema": "CASE l_linenumber WHEN 6 THEN '__internal' WHEN 4 THEN NULL ELSE concat('s',l_suppkey%3) END",
        },
    ),
    "l_tables": View(
        "part",
        {
            "table_catalog": "concat('cat',p_partkey%5)",
            "table_schema": "concat('s',p_partkey%3)",
            "table_name": "concat('t',p_partkey)",
            "table_type": "CASE p_type WHEN 'ECONOMY' THEN 'MANAGED' WHEN 'STANDARD' THEN 'EXTERNAL' WHEN 'PROMO' THEN 'VIEW' "
            "WHEN 'MEDIUM' THEN 'FOREIGN' WHEN 'LARGE' THEN 'STREAMING_TABLE' ELSE 'MATERIALIZED_VIEW' END",
        },
    ),
    "l_catalogs": View("supplier", {"catalog_name": "concat('cat',s_suppkey)"}),
    "l_schemata": View(
        "customer",
        {"catalog_name": "concat('cat',c_custkey%100)", "schema_name": "concat('s',c_custkey)"},
    ),
    "l_file_manifest": View(
        "lineitem",
        {
            "qualified_name": _l_table("l_partkey"),
            "format": "CASE WHEN l_partkey%2=0 THEN 'delta' ELSE 'parquet' END",
            "path": "concat('/f/',l_orderkey,'-',l_linenumber,'-',l_partkey)",
            "length": "CAST(floor(l_extendedprice) AS BIGINT)",
        },
    ),
    # files are added again and again, and every third action removes one
    "l_table_log": View(
        "lineitem",
        {
            "qualified_name": _l_table("l_partkey"),
            "format": "CASE WHEN l_partkey%2=0 THEN 'delta' ELSE 'parquet' END",
            "version": "CAST(l_orderkey*8+l_linenumber AS BIGINT)",
            "action": "CASE WHEN (l_orderkey+l_linenumber)%3=0 THEN 'remove' ELSE 'add' END",
            "path": "concat('part-',l_suppkey%4)",
            "length": "CASE WHEN (l_orderkey+l_linenumber)%3=0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END",
        },
    ),
    "l_job_runs": View(
        "orders",
        {
            "job_id": "CAST(o_custkey AS STRING)",
            "period_start_time": "o_orderdate",
            "result_state": "CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'FAILED' END",
            "execution_duration_seconds": "CAST(floor(o_totalprice/1000) AS BIGINT)",
        },
    ),
    "l_jobs": View(
        "customer",
        {
            "job_id": "CAST(c_custkey AS STRING)",
            "name": "concat('Job ',c_custkey)",
            "delete_time": "CASE WHEN c_custkey%2=1 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) END",
        },
    ),
    "l_clusters": View(
        "supplier",
        {
            "cluster_id": "concat('c',s_suppkey)",
            "cluster_name": "concat('Cluster ',s_suppkey)",
            "delete_time": "CASE WHEN s_suppkey%7=0 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) END",
        },
    ),
    "l_endpoints": View(
        "supplier",
        {
            "payload": "CASE WHEN s_suppkey%13=0 THEN '{\"warehouses\":[{\"id\":' "
            "ELSE concat('{\"warehouses\":[{\"id\":\"w',s_suppkey,'\",\"name\":\"Endpoint ',s_suppkey,'\"}]}') END"
        },
    ),
    "l_principals": View(
        "supplier",
        {
            "payload": "CASE WHEN s_suppkey%13=0 THEN 'not json' "
            "ELSE concat('{\"Resources\":[{\"applicationId\":\"uuid-',s_suppkey,'\",\"displayName\":\"Service ',s_suppkey%30,'\"},"
            "{\"applicationId\":\"alt-',s_suppkey,'\",\"displayName\":\"Alt ',s_suppkey,'\"}]}') END"
        },
    ),
    "l_job_payloads": View("customer", {"job_id": "CAST(c_custkey AS STRING)", "payload": _PAYLOAD_TASKS}),
    "l_experiments": View(
        "customer",
        {"delete_time": "CASE WHEN c_custkey%5=0 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) END"},
    ),
    "l_runs": View(
        "events",
        {
            "start_time": "ts",
            "status": "CASE event_type WHEN 'purchase' THEN 'FINISHED' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN NULL ELSE 'RUNNING' END",
        },
    ),
    "l_served_entities": View(
        "customer",
        {
            "entity_type": "c_mktsegment",
            "endpoint_delete_time": "CASE WHEN c_custkey%4=0 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) END",
        },
    ),
    "l_endpoint_usage": View(
        "events",
        {
            "request_time": "ts",
            "input_token_count": f"CAST(CASE WHEN event_type='view' THEN NULL ELSE {K}*10 END AS BIGINT)",
            "output_token_count": "CAST(CASE WHEN event_type IN ('view','click') THEN NULL ELSE user_id END AS BIGINT)",
        },
    ),
    "l_gateway_usage": View(
        "events",
        {
            "event_time": "ts",
            "destination_type": f"CASE WHEN {K}%9=0 THEN NULL ELSE event_type END",
            "destination_name": f"CASE WHEN {K}%4=0 THEN NULL ELSE concat('model_',{K}%4) END",
            "total_tokens": f"CAST(CASE WHEN event_type='view' THEN NULL ELSE {K}*7 END AS BIGINT)",
        },
    ),
    "l_quality_results": View(
        "events",
        {
            "event_time": "ts",
            "table_id": f"CASE WHEN {K}%17=0 THEN NULL ELSE concat('t',user_id) END",
            "status": f"CASE WHEN event_type='error' THEN 'Unhealthy' WHEN {K}%6=0 THEN NULL ELSE 'Healthy' END",
        },
    ),
    "l_classification": View(
        "customer",
        {"table_id": "CASE WHEN c_custkey%11=0 THEN NULL ELSE concat('t',c_nationkey) END"},
    ),
}


def _object_struct(name: str, domain) -> F.Column:
    return F.struct(F.col(name).alias("objectName"), domain.alias("objectDomain"))


def _nest_access(df: DataFrame) -> DataFrame:
    reads = F.array(
        _object_struct("read_name", F.col("read_domain")), _object_struct("read_name_2", F.lit("Table"))
    )
    write = _object_struct("write_name", F.lit("Table"))
    return df.select(
        "query_id",
        "user_name",
        "query_start_time",
        F.when(F.col("has_reads"), reads).alias("base_objects_accessed"),
        F.when(F.col("write_name").isNotNull(), F.array(write)).alias("objects_modified"),
    )


NEST: dict[str, Callable[[DataFrame], DataFrame]] = {
    "w_access_history": _nest_access,
    "w_shares": lambda df: df.withColumnRenamed("to_list", "to"),
    "w_lifecycle": lambda df: df.withColumnsRenamed({"database_name": "database", "schema_name": "schema"}),
    "l_usage": lambda df: df.withColumn("identity_metadata", F.struct("run_as")).drop("run_as"),
    "l_list_prices": lambda df: df.withColumn("pricing", F.struct(F.col("price").alias("default"))).drop("price"),
    "l_query_history": lambda df: df.withColumn(
        "compute", F.struct(F.col("compute_type").alias("type"), "warehouse_id", "cluster_id")
    ).drop("compute_type", "warehouse_id", "cluster_id"),
    "l_audit": lambda df: df.withColumn("user_identity", F.struct("email")).drop("email"),
}


class Tables:
    """The raw usage tables of one data directory: ``Tables(spark, dir)["w_metering"]``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._opened: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        """A driver table, opened once: every open lists files and reads a footer."""
        if name not in self._opened:
            if name.startswith("range("):
                self._opened[name] = self.spark.range(int(name[6:-1]))
            else:
                self._opened[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._opened[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = self._build(name)
        return self._views[name]

    def _build(self, name: str) -> DataFrame:
        view = VIEWS[name]
        df = self.source(view.source).selectExpr(*[f"{e} AS {c}" for c, e in view.columns.items()])
        if view.distinct:
            df = df.distinct()
        return NEST[name](df) if name in NEST else df


def with_views(body: str, *names: str, ctes: dict[str, str] | None = None) -> str:
    """A DuckDB statement: the named views (and further named sub-queries) as CTEs, then ``body``."""
    parts = [f"{n} AS ({VIEWS[n].sql()})" for n in names]
    parts += [f"{n} AS ({q})" for n, q in (ctes or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
