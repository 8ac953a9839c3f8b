"""Classification of users, clients, statements, errors and objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlens.functions._cols import ColumnLike, col

# --- fixed values: the labels and patterns that results are compared on -------

PERSON = "PERSON"
UNCLASSIFIED = "Unclassified"
SERVICE_MARK = "SERVICE"
ACTOR_PERSON = "person"
ACTOR_SERVICE = "service"
UNKNOWN = "Unknown"

# Statement verb -> label, tested in this order.
STATEMENT_LABELS = (
    ("CALL", "Stored Procedure Call"),
    ("EXECUTE IMMEDIATE", "EXECUTE IMMEDIATE"),
    ("MERGE", "MERGE"),
    ("INSERT", "INSERT"),
    ("UPDATE", "UPDATE"),
    ("DELETE", "DELETE"),
    ("COPY", "COPY INTO"),
    ("CREATE", "CREATE"),
    ("ALTER", "ALTER"),
    ("TRUNCATE", "TRUNCATE"),
)
OTHER_STATEMENT = "Other SQL"

# Job task key -> label.
TASK_LABELS = {
    "notebook_task": "Notebook",
    "spark_jar_task": "JAR",
    "python_wheel_task": "Python Wheel",
    "spark_python_task": "Python Script",
    "spark_submit_task": "Spark Submit",
    "sql_task": "SQL",
    "dbt_task": "dbt",
    "pipeline_task": "DLT Pipeline",
    "run_job_task": "Run Job",
    "for_each_task": "For Each",
    "condition_task": "Condition",
    "dashboard_task": "Dashboard",
    "unknown_task": "Unknown",
}

CLIENT_VERSION = r"\s+v?[0-9][0-9a-zA-Z.\-]*$"
ERROR_CLASS = r"^\[([A-Z_0-9]+)\]"
OTHER_ERROR = "OTHER"
SAMPLE_LENGTH = 160
COMPUTE_MARK = "COMPUTE"
ADJUSTMENT_MARK = "adj"
INTERNAL_PREFIX = "__"

# ------------------------------------------------------------------------------


def _filled(c: Column) -> Column:
    """True when the text has something besides white space (NULL gives false)."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def actor_type(identity: ColumnLike) -> Column:
    """Identities that look like an e-mail address are people; the rest, NULL too, are services."""
    return F.when(col(identity).contains("@"), ACTOR_PERSON).otherwise(ACTOR_SERVICE)


def is_employee(name: ColumnLike, domain: str) -> Column:
    return F.coalesce(F.lower(col(name)).endswith("@" + domain.lower()), F.lit(False))


def classify_user_type(name: ColumnLike, raw_type: ColumnLike, domain: str) -> Column:
    raw = col(raw_type)
    return F.when(_filled(raw), raw).when(is_employee(name, domain), PERSON).otherwise(UNCLASSIFIED)


def is_service_account(name: ColumnLike, raw_type: ColumnLike, domain: str) -> Column:
    return F.upper(classify_user_type(name, raw_type, domain)).contains(SERVICE_MARK)


def bucket_people(name: ColumnLike, domain: str, label: str) -> Column:
    """All employees share one label, everyone else keeps the own name."""
    return F.when(is_employee(name, domain), F.lit(label)).otherwise(col(name))


def display_name(actor: ColumnLike, known_name: ColumnLike, domain: str, label: str) -> Column:
    """Employee label, else the known name of the principal, else the raw identity."""
    return F.when(is_employee(actor, domain), F.lit(label)).otherwise(F.coalesce(col(known_name), col(actor)))


def compute_name(
    endpoint_id: ColumnLike,
    endpoint_name: ColumnLike,
    cluster_id: ColumnLike,
    cluster_name: ColumnLike,
    compute_type: ColumnLike,
) -> Column:
    return F.coalesce(
        F.when(col(endpoint_id).isNotNull(), F.coalesce(col(endpoint_name), col(endpoint_id))),
        F.when(col(cluster_id).isNotNull(), F.coalesce(col(cluster_name), col(cluster_id))),
        col(compute_type),
    )


def base_client_name(client: ColumnLike) -> Column:
    """Client name without its trailing version; blank and NULL give ``Unknown``."""
    c = col(client)
    return F.when(_filled(c), F.regexp_replace(F.trim(c), CLIENT_VERSION, "")).otherwise(UNKNOWN)


def classify_statement(text: ColumnLike) -> Column:
    verb = F.upper(F.trim(col(text)))
    label = F.when(~_filled(col(text)), UNKNOWN)
    for prefix, name in STATEMENT_LABELS:
        label = label.when(verb.startswith(prefix), name)
    return label.otherwise(OTHER_STATEMENT)


def friendly_task_type(task_key: ColumnLike) -> Column:
    """Known label, else the key without ``_task`` in title case (word tails keep their case)."""
    key = col(task_key)
    labels = F.create_map(*[F.lit(x) for pair in TASK_LABELS.items() for x in pair])
    stem = F.regexp_replace(F.regexp_replace(key, "_task$", ""), "_+$", "")
    words = F.transform(F.split(stem, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    return F.coalesce(F.try_element_at(labels, key), F.array_join(words, " "))


def error_class(message: ColumnLike) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(message), ERROR_CLASS, 1), F.lit("")), F.lit(OTHER_ERROR))


def sample_message(message: ColumnLike) -> Column:
    return F.substring(F.coalesce(col(message), F.lit("")), 1, SAMPLE_LENGTH)


def not_internal_schema(schema: ColumnLike) -> Column:
    return col(schema).isNull() | ~col(schema).startswith(INTERNAL_PREFIX)


def qualified_name(*parts: ColumnLike) -> Column:
    """Parts joined by dots, NULL if one is NULL: a name with a gap could be that of another table."""
    return F.concat(*[x for p in parts for x in (F.lit("."), col(p))][1:])


def default_label(value: ColumnLike, label: str = UNKNOWN, blank_too: bool = False) -> Column:
    v = col(value)
    return F.coalesce(F.nullif(v, F.lit("")) if blank_too else v, F.lit(label))


def yes_no_to_bool(flag: ColumnLike) -> Column:
    """``YES`` or ``true`` in any case; anything else, NULL too, is false."""
    return F.coalesce(F.upper(col(flag)).isin("YES", "TRUE"), F.lit(False))


def policy_options(options: ColumnLike) -> tuple[Column, Column]:
    """Archive tier (``Unknown`` if unset) and archive days (0 if unset) of a JSON options column."""
    o = col(options)
    tier = F.get_json_object(o, "$.ARCHIVE_TIER")
    days = F.get_json_object(o, "$.ARCHIVE_FOR_DAYS").try_cast("int")
    return F.coalesce(tier, F.lit(UNKNOWN)), F.coalesce(days, F.lit(0))


def is_compute_sku(sku: ColumnLike) -> Column:
    return col(sku).contains(COMPUTE_MARK)


def is_adjustment(usage_type: ColumnLike) -> Column:
    return F.coalesce(F.lower(col(usage_type)).contains(ADJUSTMENT_MARK), F.lit(False))
