"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the plans rely on.  Joins carry no size hints: a side is broadcast when
# Spark's own statistics (or, at run time, the size of its shuffle output) are under
# the threshold, else the join shuffles and AQE splits its skewed partitions.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # days of a report per task before a percentile aggregate falls back to sorting the log
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}

# Cluster start values: many small shuffle partitions that AQE merges to the advisory size.
CLUSTER_CONF = {
    **PLAN_CONF,
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "meterlens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in PLAN_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests) falls back to a temporary folder; on a cluster each
    executor would write to its own disk, so there it is an error.  The folders below it belong to the
    caller, who removes them when the results are read.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if shared:
        return f"{shared.rstrip('/')}/meterlens/{purpose}-{uuid.uuid4().hex}"
    return f"{tempfile.mkdtemp(prefix='meterlens-')}/{purpose}"
