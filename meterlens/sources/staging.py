"""Staged results: Parquet for tables, one-row frames for scalars, JSON for the summary.

A written stage also cuts the lineage: a report that is rebuilt from stage reads files, and a
lost executor costs a re-read instead of a recomputation.  A stage has a record, written last, that
holds its schema and window; what a killed write leaves behind has none and counts as never staged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meterlens.schemas import schema


def stage_path(stage_dir: str, name: str) -> str:
    return f"{stage_dir.rstrip('/')}/{name}.parquet"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


#: Beside the files of a stage; readers pass over names that begin with an underscore.
RECORD = "_stage.json"
#: Spark's own mark of a finished write.
SUCCESS = "_SUCCESS"


def write_record(spark: SparkSession, path: str, record: Mapping[str, object]) -> None:
    """Put the record into a stage, in one step: a half-written one is never seen under its name."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target, draft = jvm.Path(f"{path}/{RECORD}"), jvm.Path(f"{path}/_draft-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    try:
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(draft, target):
        raise OSError(f"the record of {path} could not be written")


def read_record(spark: SparkSession, path: str) -> dict | None:
    """The record of a stage, ``None`` if it has none."""
    if not path_exists(spark, f"{path}/{RECORD}"):
        return None
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{RECORD}")
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def stage_write(df: DataFrame, stage_dir: str, name: str, window: str | None = None) -> str:
    path = stage_path(stage_dir, name)
    df.write.mode("overwrite").parquet(path)  # which removes the old record with the old files
    write_record(df.sparkSession, path, {"schema": df.schema.json(), "window": window})
    return path


def stage_write_bucketed(df: DataFrame, stage_dir: str, name: str, key: str, buckets: int) -> DataFrame:
    """Stage the distinct rows of a table in ``buckets`` files by the hash of ``key``, and read it back as a bucketed table.

    The one shuffle of this write serves every later aggregate or join whose keys contain ``key``.  Buckets are
    known to a catalog only, so the files are also a table of the session's catalog, of a new name each time.
    """
    path, table = stage_path(stage_dir, name), f"meterlens_{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).distinct()  # equal rows are in one partition already
    dealt.write.mode("overwrite").bucketBy(buckets, key).option("path", path).saveAsTable(table, format="parquet")
    write_record(df.sparkSession, path, {"schema": df.schema.json(), "window": None})
    return df.sparkSession.table(table)


def stage_read(
    spark: SparkSession, stage_dir: str, name: str, read_schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read if read_schema is None else spark.read.schema(read_schema)
    return reader.parquet(stage_path(stage_dir, name))


def stage_read_optional(
    spark: SparkSession, stage_dir: str, name: str, read_schema: T.StructType | None = None
) -> DataFrame | None:
    """The staged table, or ``None`` if it was never staged or its write did not end."""
    path = stage_path(stage_dir, name)
    if not path_exists(spark, f"{path}/{RECORD}") and not path_exists(spark, f"{path}/{SUCCESS}"):
        return None
    return stage_read(spark, stage_dir, name, read_schema)


def stage_scalar(row: DataFrame, stage_dir: str, name: str) -> DataFrame:
    """Stage a one-row result and return it as read back, so that a rebuild keeps its values."""
    stage_write(row, stage_dir, name)
    return stage_read(row.sparkSession, stage_dir, name, row.schema)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """Append-free write of the one-row platform summary; NULL fields are kept."""
    summary.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_summary_json(spark: SparkSession, path: str) -> DataFrame:
    """Read a platform summary; a missing one is an error that names the path."""
    try:
        return spark.read.schema(schema("platform_summary")).json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no platform summary at {path}: run that platform's report first") from e
