"""Names and job tasks out of JSON payload columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values
TASK_SUFFIX = "_task"
UNKNOWN_TASK = "unknown_task"


def name_lookup_from_json(payloads: DataFrame, items: str, id_field: str, name_field: str, payload: str = "payload") -> DataFrame:
    """``id, name`` for every element of the array ``items``; a payload that does not parse gives no rows."""
    parsed = F.from_json(F.col(payload), f"`{items}` array<struct<`{id_field}`:string,`{name_field}`:string>>")
    item = payloads.select(F.explode(parsed[items]).alias("item"))
    return item.select(
        F.coalesce(F.col(f"item.{id_field}"), F.lit("")).alias("id"),
        F.coalesce(F.col(f"item.{name_field}"), F.lit("")).alias("name"),
    )


def principal_names(payloads: DataFrame) -> DataFrame:
    return name_lookup_from_json(payloads, "Resources", "applicationId", "displayName")


def endpoint_names(payloads: DataFrame) -> DataFrame:
    return name_lookup_from_json(payloads, "warehouses", "id", "name")


def job_tasks_from_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per task of a job: its key and the first JSON key that ends in ``_task``."""
    parsed = F.from_json(F.col(payload), "settings struct<tasks:array<string>>")
    task = payloads.select("job_id", F.explode(parsed["settings"]["tasks"]).alias("task"))
    kinds = F.filter(F.json_object_keys("task"), lambda k: k.endswith(TASK_SUFFIX))
    return task.select(
        "job_id",
        F.coalesce(F.get_json_object("task", "$.task_key"), F.lit("")).alias("task_key"),
        F.coalesce(F.get(kinds, F.lit(0)), F.lit(UNKNOWN_TASK)).alias("task_type"),
    )
