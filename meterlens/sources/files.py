"""File-backed sources: the billed-usage export and table sizes from file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.functions import qualified_name, sum_long
from meterlens.schemas import schema
from meterlens.sources.staging import path_exists

# fixed values: table types that hold storage of their own
STORAGE_BEARING = ("MANAGED", "EXTERNAL", "STREAMING_TABLE", "MATERIALIZED_VIEW")


def billable_usage_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Daily billed usage exported as ``timestamp,dbus,dollars``; ``None`` if there is no export.

    A header with other names or another order is an error, not swapped columns.
    """
    if not path_exists(spark, path):
        return None
    rows = spark.read.schema(schema("l_billable_csv")).option("header", "true").option("enforceSchema", "false").csv(path)
    return rows.select(F.to_date(F.substring("timestamp", 1, 10)).alias("usage_date"), "dbus", "dollars")


def storage_bearing_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(F.col("table_type").isin(*STORAGE_BEARING)).select(
        qualified_name("table_catalog", "table_schema", "table_name").alias("qualified_name")
    )


def scan_file_manifest(spark: SparkSession, root: str, fmt: str = "parquet", depth: int = 3) -> DataFrame:
    """List the files below ``root`` as a manifest; file contents are never read.

    For small folders of plain files only: the listing is kept on the driver, and files that a table no longer
    holds are in it.  Sizes of tables with a log come from :func:`~meterlens.sources.tablelog.live_files`, those of
    other large folders from the object store's inventory export, a table with the columns of a manifest.
    The ``depth`` folders below ``root`` name the table (``catalog/schema/table``).
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return listing.select(
        F.array_join(F.slice(F.split(below, "/"), 1, depth), ".").alias("qualified_name"),
        F.lit(fmt).alias("format"),
        "path",
        "length",
    )


def table_sizes_from_files(manifest: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Format, file count and bytes of each table in a manifest, one row per table.

    A table with files of several formats (after a conversion, say) shows the one most files have.
    With ``tables`` only storage-bearing ones stay.  The manifest is folded first, so that join
    sees one row per table; a table without files contributes no row.
    """
    per_format = manifest.groupBy("qualified_name", "format").agg(
        F.count(F.lit(1)).alias("num_files"), sum_long("length").alias("size_bytes")
    )
    sizes = per_format.groupBy("qualified_name").agg(
        F.max_by("format", F.struct("num_files", "format")).alias("format"),
        sum_long("num_files").alias("num_files"),
        sum_long("size_bytes").alias("size_bytes"),
    )
    return sizes if tables is None else sizes.join(storage_bearing_tables(tables), "qualified_name", "left_semi")
