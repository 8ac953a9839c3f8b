"""Column expressions shared by the operators (built-in functions only, no UDFs)."""

from meterlens.functions.labels import (
    actor_type,
    base_client_name,
    bucket_people,
    classify_statement,
    classify_user_type,
    compute_name,
    default_label,
    display_name,
    error_class,
    friendly_task_type,
    is_adjustment,
    is_compute_sku,
    is_employee,
    is_service_account,
    not_internal_schema,
    policy_options,
    qualified_name,
    sample_message,
    yes_no_to_bool,
)
from meterlens.functions.network import cidr_range, cross_region_flag, ipv4_to_long, network_base
from meterlens.functions.numbers import (
    bytes_to_gb,
    count_where,
    exact,
    ms_to_seconds,
    per_tb_to_per_gb,
    safe_percent,
    safe_ratio,
    seconds_to_hours,
    sum_double,
    sum_exact,
    sum_long,
)
from meterlens.functions.timewindow import (
    Lookback,
    day_of,
    lookback_date,
    lookback_ts,
    month_of,
    months_between,
    not_deleted,
    positive_duration,
)

__all__ = [name for name in dir() if not name.startswith("_")]
