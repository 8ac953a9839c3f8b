"""Live files of tables from their transaction logs.

A log names every file that a version of a table adds or removes.  Replaying it gives the files of the current (or
an earlier) version, without listing storage, and leaves out files that are still there but no longer belong to the
table.  The replay is one hash aggregate over (table, file): of each file only its last version as added, as removed,
and its size then are kept, so a table with a third of all files is spread over its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADD, REMOVE = "add", "remove"
LOG_FOLDER = "_delta_log"
LOG_FORMAT = "delta"
_ACTION_SCHEMA = "add struct<path: string, size: bigint>, remove struct<path: string>"


def scan_table_log(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """The add and remove actions in the logs of all tables below ``root``, as rows of ``l_table_log``.

    The ``depth`` folders below ``root`` name the table (``catalog/schema/table``).  Commits are JSON lines named by
    their version; checkpoints are Parquet files that hold what was live at theirs, so that older commits may be gone.
    Only log files are listed, never data files.
    """
    tables = f"{root.rstrip('/')}/{'/'.join('*' * depth)}/{LOG_FOLDER}"

    def actions(rows: DataFrame) -> DataFrame:
        file = F.col("_metadata.file_path")
        folder = F.split(F.substring_index(file, f"/{LOG_FOLDER}/", 1), "/")
        each = F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit(ADD).alias("action"), F.col("add.path").alias("path"), F.col("add.size").alias("length")),
                    F.struct(F.lit(REMOVE).alias("action"), F.col("remove.path").alias("path"), F.lit(None).cast("long").alias("length")),
                ),
                lambda a: a.path.isNotNull(),
            )
        )
        version = F.substring_index(F.element_at(F.split(file, "/"), -1), ".", 1).cast("long")
        name = F.array_join(F.transform(F.slice(folder, -depth, depth), lambda part: F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))), ".")
        return rows.select(name.alias("qualified_name"), version.alias("version"), each).select(
            "qualified_name", F.lit(LOG_FORMAT).alias("format"), "version", "action", "path", "length"
        )

    reader = spark.read.schema(_ACTION_SCHEMA)
    commits = actions(reader.option("pathGlobFilter", "*[0-9].json").json(tables))
    return commits.unionByName(actions(reader.option("pathGlobFilter", "*.checkpoint*.parquet").parquet(tables)))


def live_files(log: DataFrame, version: int | None = None) -> DataFrame:
    """A manifest (``l_file_manifest``) of the files that belong to each table after all its actions.

    The last action on a file decides; an add and a remove of one version leave the file in (its deletion marks
    were replaced).  With ``version`` later actions do not count.
    """
    rows = log if version is None else log.filter(F.col("version") <= version)
    added, removed = (F.when(F.col("action") == kind, F.col("version")) for kind in (ADD, REMOVE))
    # numbers only, so that the aggregate hashes
    last = rows.groupBy("qualified_name", "format", "path").agg(
        F.max(added).alias("_added"), F.max(removed).alias("_removed"), F.max_by("length", added).alias("length")
    )
    live = F.col("_added").isNotNull() & (F.col("_removed").isNull() | (F.col("_added") >= F.col("_removed")))
    return last.filter(live).select("qualified_name", "format", "path", F.coalesce("length", F.lit(0)).alias("length"))
