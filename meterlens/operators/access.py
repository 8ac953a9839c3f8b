"""Table access: who reads and writes which table, and which tables nobody touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import (
    Lookback,
    bucket_people,
    bytes_to_gb,
    display_name,
    not_deleted,
    not_internal_schema,
    qualified_name,
)
from meterlens.operators.lookup import attach, attach_to_top
from meterlens.operators.ranking import top_k
from meterlens.operators.users import service_account_filter

READ, WRITE = "READ", "WRITE"
TABLE_DOMAIN = "Table"


# ---- warehouse ---------------------------------------------------------------


def access_events(access_history: DataFrame, window: Lookback) -> DataFrame:
    """One row per object a query read or modified.

    Each query is unfolded into its two lists and each list into its objects, so the log is
    scanned once; a missing list gives no rows.
    """

    def tagged(action: str, column: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.col(column).alias("objects"))

    lists = F.inline(F.array(tagged(READ, "base_objects_accessed"), tagged(WRITE, "objects_modified")))
    rows = access_history.filter(window.ts("query_start_time")).select("query_id", "user_name", lists)
    return rows.select("query_id", "user_name", "action", F.explode("objects").alias("o")).select(
        "query_id",
        "user_name",
        F.col("o.objectName").alias("object_name"),
        F.col("o.objectDomain").alias("object_domain"),
        "action",
    )


def by_query(events: DataFrame) -> DataFrame:
    """Events dealt out by query: every grain of distinct queries then folds without another shuffle of them."""
    return events.repartition("query_id")


def distinct_queries(events: DataFrame, *keys: str | Column) -> DataFrame:
    """Distinct queries per key, over tables only.

    First one row per (key, query), then a count: a hot table or user is spread over the query
    ids.  Each grain counts its own, a coarser one is not the sum of a finer one.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    pairs = events.filter(F.col("object_domain") == TABLE_DOMAIN).select(*columns, "query_id").distinct()
    names = [c for c in pairs.columns if c != "query_id"]
    return pairs.groupBy(*names).agg(F.count("query_id").alias("distinct_queries"))


def w_table_access_counts(events: DataFrame) -> DataFrame:
    return distinct_queries(events, "object_name")


def w_top_accessed_tables(access_counts: DataFrame, limit: int = 30) -> DataFrame:
    return top_k(access_counts, limit, "distinct_queries", "object_name")


def w_table_rw_by_user(events: DataFrame) -> DataFrame:
    return distinct_queries(events, "object_name", "user_name", "action")


def w_user_action_counts(events: DataFrame) -> DataFrame:
    return distinct_queries(events, "user_name", "action")


def w_user_table_counts(events: DataFrame, user_types: DataFrame, domain: str, limit: int = 50) -> DataFrame:
    """Tables that service accounts use most; reading and writing one table in a query counts once.

    Other users' events leave before the distinct count shuffles them.
    """
    counts = distinct_queries(service_account_filter(events, user_types, domain), "user_name", "object_name")
    return top_k(counts, limit, "distinct_queries", "user_name", "object_name")


def live_tables(table_storage: DataFrame) -> DataFrame:
    """Live tables with their name, size and the case-folded name they are matched by."""
    name = qualified_name("table_catalog", "table_schema", "table_name")
    return table_storage.filter(not_deleted("deleted", flag=True)).select(
        name.alias("qualified_name"),
        F.upper(name).alias("match_name"),
        F.coalesce("active_bytes", F.lit(0)).alias("active_bytes"),
    )


def _table_events(events: DataFrame) -> DataFrame:
    """Table events keyed by the case-folded name, ahead of any distinct count."""
    return events.filter(F.col("object_domain") == TABLE_DOMAIN).withColumn("match_name", F.upper("object_name"))


def dead_tables(table_storage: DataFrame, events: DataFrame, limit: int = 30) -> DataFrame:
    """Largest tables without any access.  The accessed side is cut to distinct names first."""
    accessed = _table_events(events).select("match_name").distinct()
    dead = live_tables(table_storage).join(accessed, "match_name", "left_anti")
    return top_k(dead, limit, "active_bytes", "qualified_name").select(
        "qualified_name", bytes_to_gb("active_bytes").alias("active_gb")
    )


def size_vs_access(table_storage: DataFrame, events: DataFrame, limit: int = 200) -> DataFrame:
    """The largest tables with their number of queries.

    At most ``limit`` names are broadcast to the log, which drops all other events before the
    distinct count.
    """
    largest = top_k(live_tables(table_storage), limit, "active_bytes", "qualified_name")
    names = F.broadcast(largest.select("match_name").distinct())
    counts = distinct_queries(_table_events(events).join(names, "match_name", "left_semi"), "match_name")
    return largest.join(counts, "match_name", "left").select(
        "qualified_name",
        bytes_to_gb("active_bytes").alias("active_gb"),
        F.coalesce("distinct_queries", F.lit(0)).alias("distinct_queries"),
    )


def w_table_access_detail(
    table_storage: DataFrame, events: DataFrame, domain: str, label: str, limit: int = 150
) -> DataFrame:
    """Reads and writes per table and user bucket, the busiest first, with the size of the table.

    A query has one user, so its bucket is part of the distinct key.  Tables are matched by their case-folded
    name and shown under the smallest of the names they were used by.  Counts and names both fold the events where
    they lie: give events that are dealt :func:`by_query` or staged in buckets by query.
    """
    columns = ("match_name", "object_name", "object_domain", "user_name", "action", "query_id")
    used = _table_events(events).withColumn("user_name", bucket_people("user_name", domain, label)).select(*columns).distinct()
    counts = (
        distinct_queries(used, "match_name", "user_name", "action")
        .groupBy("match_name", "user_name")
        .agg(*[_action_sum(action, name) for action, name in ((READ, "read_count"), (WRITE, "write_count"))])
    )
    top = top_k(counts, limit, F.col("read_count") + F.col("write_count"), "match_name", "user_name")
    sizes = live_tables(table_storage).groupBy("match_name").agg(F.sum("active_bytes").alias("active_bytes"))
    names = used.groupBy("match_name", "object_name").agg(F.count(F.lit(1)).alias("_touches"))
    named = attach_to_top(top, "match_name", sizes, "match_name", "active_bytes", "_bytes")
    return attach_to_top(named, "match_name", names, "match_name", "object_name", "_name", F.min).select(
        F.col("_name").alias("qualified_name"),
        bytes_to_gb(F.coalesce("_bytes", F.lit(0))).alias("active_gb"),
        "user_name",
        "read_count",
        "write_count",
    )


def _action_sum(action: str, name: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("action") == action, F.col("distinct_queries"))), F.lit(0)).alias(name)


# ---- lakehouse: lineage events -----------------------------------------------
#
# These count events.  They take the raw log with its window, or a rollup of it (no window) that
# carries the number of events in ``event_count``.

SIDES = {READ: "source", WRITE: "target"}
EVENT_COUNT = "event_count"
_LINEAGE_KEYS = (
    "created_by",
    "source_table_full_name",
    "source_table_schema",
    "target_table_full_name",
    "target_table_schema",
)


def l_lineage_rollup(lineage: DataFrame, window: Lookback) -> DataFrame:
    """Events per (identity, source, target): jobs touch the same tables day after day."""
    return lineage.filter(window.date("event_date")).groupBy(*_LINEAGE_KEYS).agg(F.count(F.lit(1)).alias(EVENT_COUNT))


def _events(lineage: DataFrame, window: Lookback | None) -> DataFrame:
    rows = lineage if window is None else lineage.filter(window.date("event_date"))
    weight = F.col(EVENT_COUNT) if EVENT_COUNT in rows.columns else F.lit(1)
    return rows.select(*_LINEAGE_KEYS, weight.cast("long").alias(EVENT_COUNT))


def _total() -> Column:
    return F.sum(EVENT_COUNT).alias("access_count")


def _side(lineage: DataFrame, window: Lookback | None, direction: str) -> DataFrame:
    """Events that read (or wrote) a named table outside the platform's internal schemas."""
    side = SIDES[direction]
    table = F.col(f"{side}_table_full_name")
    return (
        _events(lineage, window)
        .filter(table.isNotNull() & not_internal_schema(f"{side}_table_schema"))
        .select(F.col("created_by").alias("actor"), table.alias("table_name"), EVENT_COUNT)
    )


def _top_tables(lineage: DataFrame, window: Lookback | None, direction: str, limit: int) -> DataFrame:
    counts = _side(lineage, window, direction).groupBy("table_name").agg(_total())
    return top_k(counts, limit, "access_count", "table_name").select(
        F.lit(direction).alias("direction"), "table_name", "access_count"
    )


def l_top_read_tables(lineage: DataFrame, window: Lookback | None = None, limit: int = 20) -> DataFrame:
    return _top_tables(lineage, window, READ, limit)


def l_top_write_tables(lineage: DataFrame, window: Lookback | None = None, limit: int = 20) -> DataFrame:
    return _top_tables(lineage, window, WRITE, limit)


def _user_tables(lineage: DataFrame, window: Lookback | None, direction: str, limit: int) -> DataFrame:
    rows = _side(lineage, window, direction).filter(F.col("actor").isNotNull())
    counts = rows.groupBy("actor", "table_name").agg(_total())
    return top_k(counts, limit, "access_count", "actor", "table_name").select(
        "actor", "table_name", F.lit(direction).alias("direction"), "access_count"
    )


def l_user_table_reads(lineage: DataFrame, window: Lookback | None = None, limit: int = 150) -> DataFrame:
    return _user_tables(lineage, window, READ, limit)


def l_user_table_writes(lineage: DataFrame, window: Lookback | None = None, limit: int = 150) -> DataFrame:
    return _user_tables(lineage, window, WRITE, limit)


def l_table_access_detail(
    lineage: DataFrame,
    principals: DataFrame,
    table_sizes: DataFrame,
    domain: str,
    label: str,
    window: Lookback | None = None,
    limit: int = 150,
) -> DataFrame:
    """Reads and writes per displayed identity and table, merged uncapped and then ranked.

    Both directions come from one scan: an event carries up to two (table, direction) pairs.
    """

    def touched(direction: str) -> Column:
        side = SIDES[direction]
        ok = F.col(f"{side}_table_full_name").isNotNull() & not_internal_schema(f"{side}_table_schema")
        return F.when(ok, F.struct(F.col(f"{side}_table_full_name").alias("table"), F.lit(direction).alias("direction")))

    def events_in(direction: str) -> Column:
        return F.sum(F.when(F.col("p.direction") == direction, F.col(EVENT_COUNT)).otherwise(F.lit(0)))

    pairs = F.array(touched(READ), touched(WRITE))
    per_identity = (
        _events(lineage, window)
        .filter(F.col("created_by").isNotNull())
        .select("created_by", EVENT_COUNT, F.explode(pairs).alias("p"))
        .filter(F.col("p").isNotNull())
        .groupBy("created_by", F.col("p.table").alias("table_name"))
        .agg(events_in(READ).alias("reads"), events_in(WRITE).alias("writes"))
    )
    named = attach(per_identity, "created_by", principals, "id", "name", "_name")
    counts = named.groupBy(display_name("created_by", "_name", domain, label).alias("actor"), "table_name").agg(
        F.sum("reads").alias("read_count"), F.sum("writes").alias("write_count")
    )
    top = top_k(counts, limit, F.col("read_count") + F.col("write_count"), "actor", "table_name")
    return attach_to_top(top, "table_name", table_sizes, "qualified_name", "size_bytes", "size_bytes")


def l_service_account_tables(
    lineage: DataFrame,
    principals: DataFrame,
    domain: str,
    label: str,
    window: Lookback | None = None,
    limit: int = 30,
) -> DataFrame:
    """Tables that non-person identities touch most; the source counts where an event has both."""
    rows = _events(lineage, window).filter(
        ~F.col("created_by").contains("@")
        & not_internal_schema("source_table_schema")
        & not_internal_schema("target_table_schema")
    )
    counts = rows.groupBy(
        F.col("created_by").alias("identity"),
        F.coalesce("source_table_full_name", "target_table_full_name").alias("table_name"),
    ).agg(_total())
    top = top_k(counts, limit, "access_count", "identity", "table_name")
    return attach(top, "identity", principals, "id", "name", "_name").select(
        display_name("identity", "_name", domain, label).alias("actor"), "table_name", "access_count"
    )
