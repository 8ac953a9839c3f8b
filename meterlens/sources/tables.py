"""Usage tables and the small inventories and dimensions read from them."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.functions import not_deleted, yes_no_to_bool
from meterlens.schemas import SchemaMismatch, conform, schema

JDBC_PARTITIONING = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def scan_usage_table(
    spark: SparkSession, table: str, location: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Open a usage table and check it against its declared schema.

    ``fmt="table"`` reads a catalog table, ``fmt="jdbc"`` a live source (which needs
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``, else one task would read
    it all); any other format is a path.  Filters and column lists of the operators on top
    reach the scan, so no SQL is written by hand.
    """
    reader = spark.read.options(**options)
    if fmt == "table":
        df = reader.table(location)
    elif fmt == "jdbc":
        missing = [o for o in JDBC_PARTITIONING if o.lower() not in {k.lower() for k in options}]
        if missing:
            raise ValueError(f"a JDBC source is read in parallel only with {', '.join(missing)}")
        df = reader.format("jdbc").option("dbtable", location).load()
    else:
        df = reader.format(fmt).load(location)
    return conform(df, table)


def optional_source(
    spark: SparkSession,
    label: str,
    load: Callable[[], DataFrame],
    empty_as: str | None = None,
) -> DataFrame | None:
    """A source that an edition or a grant may hide.

    Unavailability shows when Spark resolves the source (a missing table or column, a refused
    connection), before any job runs; then the result is ``None``, or an empty frame of the schema
    ``empty_as``.  Errors of the caller's own code are not hidden.
    """
    try:
        return load()
    except (PySparkException, Py4JJavaError, SchemaMismatch) as e:
        reason = (str(e).splitlines() or [""])[0]
        warnings.warn(f"skipping {label}: {reason}", stacklevel=2)
        return None if empty_as is None else empty_table(spark, empty_as)


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    """No rows in the schema of a usage table; Catalyst drops it from unions and joins."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table)]
    return spark.range(1).select(*columns).limit(0)


def scan_streams_inventory(streams: DataFrame) -> DataFrame:
    return streams.select(
        F.col("name").alias("stream_name"), "database_name", "schema_name", yes_no_to_bool("stale").alias("stale")
    )


def scan_shares_inventory(shares: DataFrame) -> DataFrame:
    return shares.select(
        F.col("name").alias("share_name"), "kind", "database_name", F.col("to").alias("to_accounts")
    )


def job_names(jobs: DataFrame) -> DataFrame:
    return jobs.filter(not_deleted("delete_time")).select("job_id", "name")


def cluster_names(clusters: DataFrame) -> DataFrame:
    return clusters.filter(not_deleted("delete_time")).select("cluster_id", "cluster_name")


def user_types(users: DataFrame) -> DataFrame:
    return users.filter(not_deleted("deleted_on")).select("user_name", "user_type")
