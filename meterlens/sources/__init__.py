"""Scans, staging and payload parsing."""

from meterlens.sources.files import billable_usage_csv, scan_file_manifest, storage_bearing_tables, table_sizes_from_files
from meterlens.sources.payloads import endpoint_names, job_tasks_from_json, name_lookup_from_json, principal_names
from meterlens.sources.staging import (
    read_summary_json,
    stage_read,
    stage_read_optional,
    stage_scalar,
    stage_write,
    write_summary_json,
)
from meterlens.sources.tablelog import live_files, scan_table_log
from meterlens.sources.tables import (
    cluster_names,
    job_names,
    optional_source,
    scan_shares_inventory,
    scan_streams_inventory,
    scan_usage_table,
    user_types,
)

__all__ = [name for name in dir() if not name.startswith("_")]
