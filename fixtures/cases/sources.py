"""Scans, staging round trips, payload parsing."""

from pyspark.sql import functions as F

from fixtures.cases.access import MANIFEST, TS
from fixtures.cases.activity import BY_USER, CLUSTERS, DAILY_CREDITS, L_OVERVIEW, LH, MET, RECENT, USER_TYPES, WH
from fixtures.cases.cost import BILLABLE, L_DAILY, PR, PV, REAL, REAL_CTES, priced
from fixtures.cases.inventory import BEARING, SIZED, TASK_ROWS, sizes
from fixtures.cases.registry import EV, LI, case
from fixtures.cases.users import PRINCIPALS
from meterlens import sources as s
from meterlens.functions import day_of
from meterlens.operators import activity as a
from meterlens.operators import cost, ranking
from meterlens.operators.lookup import dimension_lookups
from meterlens.operators.automation import l_job_rollup
from meterlens.schemas import schema
from meterlens.session import scratch_dir
from fixtures.cases.registry import OR
from fixtures.cases.inventory import JOB_ROLL, JR


def _scan(t):
    path = s.staging.stage_path(scratch_dir(t.spark, "scan"), TS)
    t[TS].write.parquet(path)
    return s.scan_usage_table(t.spark, TS, path)


case("scan_usage_table", _scan, f"SELECT * FROM {TS}", TS)


def _stage_write(t):
    path = s.stage_write(a.w_daily_query_by_user(t[WH], EV), scratch_dir(t.spark, "stage-write"), "daily_query_by_user")
    return t.spark.read.parquet(path)


case("stage_write", _stage_write, BY_USER, WH)


def _stage_read(t):
    stage = scratch_dir(t.spark, "stage-read")
    credits = a.w_daily_credits(t[MET], EV)
    s.stage_write(credits, stage, "daily_credits")
    return s.stage_read(t.spark, stage, "daily_credits", credits.schema)


case("stage_read", _stage_read, DAILY_CREDITS, MET)


def _stage_read_optional(t):
    """One staged table and one that never was."""
    stage = scratch_dir(t.spark, "stage-optional")
    s.stage_write(a.w_daily_credits(t[MET], EV), stage, "daily_credits")
    found = s.stage_read_optional(t.spark, stage, "daily_credits")
    absent = s.stage_read_optional(t.spark, stage, "query_attribution") is None
    return found.withColumn("other_is_absent", F.lit(absent))


case(
    "stage_read_optional",
    _stage_read_optional,
    "SELECT *, TRUE AS other_is_absent FROM d",
    MET,
    ctes={"d": DAILY_CREDITS},
)


def _optional_source(t):
    """A source that resolves, and one that does not and is replaced by its empty default."""
    found = s.optional_source(t.spark, MET, lambda: t[MET])
    missing = s.optional_source(
        t.spark, "attribution", lambda: t.spark.read.parquet(f"{t.sf_dir}/no_such_table"), empty_as="w_attribution"
    )
    return found.select("warehouse_name", "credits_used").unionByName(
        missing.select(F.col("user_name").alias("warehouse_name"), F.col("credits_attributed_compute").alias("credits_used"))
    )


case("optional_source", _optional_source, f"SELECT warehouse_name, credits_used FROM {MET}", MET)
case(
    "stage_scalar",
    lambda t: s.stage_scalar(a.l_overview(t[LH], EV), scratch_dir(t.spark, "stage-scalar"), "overview"),
    L_OVERVIEW,
    LH,
)


def write_billable(t):
    """The billed export of the fixture: daily totals of the usage at 0.8, as CSV text."""
    path = scratch_dir(t.spark, "billable")
    daily = t["l_usage"].groupBy("usage_date").agg(
        F.round(F.sum("usage_quantity"), 6).alias("dbus"), F.round(F.sum("usage_quantity") * 0.8, 6).alias("dollars")
    )
    stamp = F.concat(day_of("usage_date"), F.lit("T00:00:00Z")).alias("timestamp")
    daily.select(stamp, "dbus", "dollars").write.option("header", "true").csv(path)
    return path


BILLABLE_ROWS = f"SELECT usage_date, dbus AS dbus, dollars FROM ({BILLABLE})"


def billable(t):
    return s.billable_usage_csv(t.spark, write_billable(t))


case("billable_usage_csv", billable, BILLABLE_ROWS, "l_usage")
case(
    "l_real_billed_total",
    lambda t: cost.l_real_billed_total(billable(t), cost.l_daily_cost(priced(t, "usage_date"))),
    REAL,
    *PV,
    ctes=REAL_CTES,
)


def _discount(t):
    daily = cost.l_daily_cost(priced(t, "usage_date"))
    return cost.l_discount(cost.l_real_billed_total(billable(t), daily), daily)


case(
    "l_discount",
    _discount,
    "SELECT round(real_total_usd / (SELECT sum(usd) FROM daily), 6) AS real_billed_discount_ratio, "
    "round((1.0::DOUBLE - real_total_usd / (SELECT sum(usd) FROM daily)) * 100, 6) AS discount_percent FROM real",
    *PV,
    ctes=REAL_CTES | {"real": REAL},
)
case(
    "scan_streams_inventory",
    lambda t: s.scan_streams_inventory(t["w_streams"]),
    "SELECT name AS stream_name, database_name, schema_name, coalesce(lower(stale) = 'true', FALSE) AS stale FROM w_streams",
    "w_streams",
)
case(
    "scan_shares_inventory",
    lambda t: s.scan_shares_inventory(t["w_shares"]),
    "SELECT name AS share_name, kind, database_name, to_list AS to_accounts FROM w_shares",
    "w_shares",
)
case("storage_bearing_tables", lambda t: s.storage_bearing_tables(t["l_tables"]), BEARING, "l_tables")
case("table_sizes_from_files", sizes, "SELECT * FROM sizes", MANIFEST, "l_tables", ctes=SIZED)
case("name_lookup_from_json", lambda t: s.principal_names(t["l_principals"]), PRINCIPALS, "l_principals")
case("job_tasks_from_json", lambda t: s.job_tasks_from_json(t["l_job_payloads"]), TASK_ROWS, "l_job_payloads")
case("job_names", lambda t: s.job_names(t["l_jobs"]), "SELECT job_id, name FROM l_jobs WHERE delete_time IS NULL", "l_jobs")
case("cluster_names", lambda t: s.cluster_names(t["l_clusters"]), CLUSTERS, "l_clusters")
case("user_types", lambda t: s.user_types(t["w_users"]), USER_TYPES, "w_users")
case(
    "dimension_lookups",
    lambda t: dimension_lookups(l_job_rollup(t[JR], OR).select("job_id", "total_runs"), s.job_names(t["l_jobs"])),
    "SELECT jr.job_id, jr.total_runs, coalesce(n.name, jr.job_id) AS job_name FROM jr "
    "LEFT JOIN (SELECT job_id, name FROM l_jobs WHERE delete_time IS NULL) n ON jr.job_id = n.job_id",
    JR,
    "l_jobs",
    ctes={"jr": JOB_ROLL},
)
case(
    "data_span",
    lambda t: ranking.data_span(cost.l_daily_cost(priced(t, "usage_date")), LI.days),
    "SELECT min(day) AS first_day, max(day) AS last_day, CAST(CAST(max(day) AS DATE) - CAST(min(day) AS DATE) + 1 AS INT) AS day_count FROM daily",
    *PV,
    ctes=PR | {"daily": L_DAILY},
)
