"""Input schemas: the columns each usage table must offer (further columns are ignored)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_OBJECTS = "array<struct<objectName:string,objectDomain:string>>"

DDL: dict[str, str] = {
    "w_users": "user_name string, user_type string, disabled boolean, deleted_on timestamp",
    "w_query_history": "query_id string, start_time timestamp, user_name string, database_name string, "
    "warehouse_name string, execution_status string, execution_time bigint, error_code string, error_message string, "
    "bytes_spilled_to_local_storage bigint, bytes_spilled_to_remote_storage bigint, "
    "queued_provisioning_time bigint, queued_overload_time bigint",
    "w_metering": "warehouse_name string, start_time timestamp, credits_used double",
    "w_table_storage": "table_catalog string, table_schema string, table_name string, active_bytes bigint, "
    "time_travel_bytes bigint, failsafe_bytes bigint, retained_for_clone_bytes bigint, deleted boolean",
    "w_database_storage": "usage_date date, database_name string, average_database_bytes double",
    "w_access_history": "query_id string, user_name string, query_start_time timestamp, "
    f"base_objects_accessed {_OBJECTS}, objects_modified {_OBJECTS}",
    "w_billing": "usage_date date, account_locator string, currency string, usage_type string, usage_in_currency double",
    "w_attribution": "user_name string, start_time timestamp, credits_attributed_compute double",
    "w_task_history": "task_name string, database_name string, schema_name string, state string, "
    "scheduled_time timestamp, query_text string",
    "w_pipe_usage": "pipe_name string, start_time timestamp, credits_used double, bytes_inserted bigint, files_inserted bigint",
    "w_streams": "name string, database_name string, schema_name string, stale string",
    "w_shares": "name string, kind string, database_name string, `to` string",
    "w_mv_refresh": "view_name string, database_name string, schema_name string, start_time timestamp, "
    "end_time timestamp, credits_used double",
    "w_data_transfer": "start_time timestamp, source_cloud string, source_region string, target_cloud string, "
    "target_region string, transfer_type string, bytes_transferred bigint",
    "w_objects": "object_type string, deleted timestamp",
    "w_sessions": "client_application_id string, created_on timestamp",
    "w_lifecycle": "name string, database string, schema string, options string, deleted_on timestamp",
    "w_login_history": "event_timestamp timestamp, client_ip string, reported_client_type string, "
    "first_authentication_factor string, second_authentication_factor string, is_success string",
    "w_replication": "replication_group_name string, start_time timestamp, credits_used double, bytes_transferred bigint",
    "network_policies": "channel string, cidr string, priority int",
    "l_usage": "usage_date date, usage_start_time timestamp, sku_name string, billing_origin_product string, "
    "usage_quantity double, identity_metadata struct<run_as:string>",
    "l_list_prices": "sku_name string, price_start_time timestamp, price_end_time timestamp, pricing struct<default:double>",
    "l_query_history": "start_time timestamp, executed_by string, "
    "compute struct<type:string,warehouse_id:string,cluster_id:string>, execution_status string, error_message string, "
    "total_duration_ms bigint, spilled_local_bytes bigint, waiting_for_compute_duration_ms bigint",
    "l_audit": "event_date date, event_time timestamp, service_name string, user_identity struct<email:string>",
    "l_lineage": "event_date date, created_by string, source_table_full_name string, source_table_schema string, "
    "target_table_full_name string, target_table_schema string",
    "l_tables": "table_catalog string, table_schema string, table_name string, table_type string",
    "l_catalogs": "catalog_name string",
    "l_schemata": "catalog_name string, schema_name string",
    "l_file_manifest": "qualified_name string, format string, path string, length bigint",
    "l_table_log": "qualified_name string, format string, version bigint, action string, path string, length bigint",
    "l_job_runs": "job_id string, period_start_time timestamp, result_state string, execution_duration_seconds bigint",
    "l_jobs": "job_id string, name string, delete_time timestamp",
    "l_clusters": "cluster_id string, cluster_name string, delete_time timestamp",
    "l_endpoints": "payload string",
    "l_principals": "payload string",
    "l_job_payloads": "job_id string, payload string",
    "l_experiments": "delete_time timestamp",
    "l_runs": "start_time timestamp, status string",
    "l_served_entities": "entity_type string, endpoint_delete_time timestamp",
    "l_endpoint_usage": "request_time timestamp, input_token_count bigint, output_token_count bigint",
    "l_gateway_usage": "event_time timestamp, destination_type string, destination_name string, total_tokens bigint",
    "l_quality_results": "event_time timestamp, table_id string, status string",
    "l_classification": "table_id string",
    "l_billable_csv": "timestamp string, dbus double, dollars double",
    "platform_summary": "platform string, lookback_days int, generated_at string, total_cost_usd double, "
    "cost_is_estimate boolean, compute_cost_usd double, compute_cost_is_estimate boolean, "
    "real_billed_discount_ratio double, total_compute_seconds double, total_queries bigint, "
    "active_users_human double, active_users_service double, failed_query_count bigint, total_tables bigint, "
    "total_schemas bigint, total_databases_or_catalogs bigint, total_storage_gb double, "
    "automation_run_count bigint, automation_success_rate_percent double",
}


class SchemaMismatch(ValueError):
    """A usage table lacks a column, or carries it with another type."""


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def _same(expected: T.DataType, actual: T.DataType) -> bool:
    if isinstance(expected, T.TimestampType):
        return isinstance(actual, (T.TimestampType, T.TimestampNTZType))
    if isinstance(expected, T.StructType):
        return isinstance(actual, T.StructType) and all(
            f.name in actual.fieldNames() and _same(f.dataType, actual[f.name].dataType) for f in expected
        )
    if isinstance(expected, T.ArrayType):
        return isinstance(actual, T.ArrayType) and _same(expected.elementType, actual.elementType)
    return expected == actual


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check a usage table against its schema and keep just the columns the operators use."""
    expected = schema(table)
    missing = [f.name for f in expected if f.name not in df.columns]
    if missing:
        raise SchemaMismatch(f"{table}: missing columns {missing}")
    wrong = [
        f"{f.name}: {df.schema[f.name].dataType.simpleString()} instead of {f.dataType.simpleString()}"
        for f in expected
        if not _same(f.dataType, df.schema[f.name].dataType)
    ]
    if wrong:
        raise SchemaMismatch(f"{table}: {'; '.join(wrong)}")
    return df.select(*[f"`{f.name}`" for f in expected])
