"""Helpers that several operators share: words, staged tables, exact order cuts, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlens.session import scratch_dir

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def bind(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generator, so that each is evaluated once however often later lambdas use it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in cols.items()]))))


def staged(spark: SparkSession, df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors, has a known size."""
    path = scratch_dir(spark, f"llm-{purpose}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Passes that run inside hand their tasks Arrow batches of about ``BATCH_BYTES``, if the session sets no size.

    Spark's own 64 MB stand in each task several times beside the heap: as vectors that grow by doubling, as the
    stream to Python, and there.  What is planned inside and runs later has the size of its own time, so stage it.
    """
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def null_safe(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    return all_of([left[k].eqNullSafe(right[k]) for k in keys])


def order_cut(
    rows: DataFrame, need: DataFrame, group: str, digest: str, amount: str, ties: list[str], digits: tuple[int, ...] = (3, 6)
) -> DataFrame:
    """Per group, the first row (in the order of ``digest``, then ``ties``) that is no longer taken.

    Rows of a group are taken in that order as long as the middle of a row's ``amount`` still lies within
    the group's ``need``, so the sum taken is at most half a row away from it.  ``digest`` is lower-case hex.
    Sums over its first three digits, then over the next three, and so on through ``digits``, narrow the place
    down; rows are sorted only within the one cell (of 16.7 million, with six digits) that holds the cut.
    Returns ``group, cut_digest, cut_<tie>...``; a group whose rows are all taken has no row.
    """
    found = need.select(F.col(group), F.col("need"), F.lit(0).cast("long").alias("before"), F.lit("").alias("cell"))
    for depth in digits:
        # the cells of a group at this depth: 4096 at most
        inside = rows.join(
            found.select(F.col(group).alias("g"), F.col("cell").alias("c"), "need", "before"),
            (F.col(group) == F.col("g")) & (F.substring(digest, 1, depth - 3) == F.col("c")),
        )
        cells = inside.groupBy(group, F.substring(digest, 1, depth).alias("cell")).agg(
            F.sum(amount).alias("part"), F.first("need").alias("need"), F.first("before").alias("base")
        )
        upto = Window.partitionBy(group).orderBy("cell")
        cells = cells.withColumn("end", F.sum("part").over(upto) + F.col("base"))
        # the last row of a cell can be left out although the cell ends before need, never the reverse
        reached = cells.filter(F.col("end") >= F.col("need"))
        first = Window.partitionBy(group).orderBy("cell")
        found = (
            reached.withColumn("at", F.row_number().over(first))
            .filter("at = 1")
            .select(group, "need", (F.col("end") - F.col("part")).alias("before"), "cell")
        )
        found = staged(rows.sparkSession, found, "cells")
    inside = rows.join(
        found.select(F.col(group).alias("g"), F.col("cell").alias("c"), "need", "before"),
        (F.col(group) == F.col("g")) & (F.substring(digest, 1, digits[-1]) == F.col("c")),
    )
    order = Window.partitionBy(group).orderBy(digest, *ties)
    late = inside.withColumn("middle", F.col("before") + F.sum(amount).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount) / 2.0)
    late = late.filter(F.col("middle") > F.col("need")).withColumn("at", F.row_number().over(order)).filter("at = 1")
    cut = late.select(group, F.col(digest).alias("cut_digest"), *[F.col(t).alias(f"cut_{t}") for t in ties])
    # nothing in the cell itself is late: the cut is the end of the cell
    whole = found.join(cut.select(F.col(group).alias("g")), F.col(group) == F.col("g"), "left_anti").select(
        group, F.concat("cell", F.lit("g")).alias("cut_digest"), *[F.lit(None).cast(rows.schema[t].dataType).alias(f"cut_{t}") for t in ties]
    )
    return cut.unionByName(whole)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b): the label is the smallest node that can be reached.

    Labels fall along links and then to the label of their label, until nothing changes.  Every round is one
    pre-aggregated minimum over the links and one join, staged; a hub's links are many small rows that a
    skewed join may split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(spark, both, "links")
    labels = staged(spark, both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        fallen = both.join(known, "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(fallen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        heads = lower.select(F.col("node").alias("head"), F.col("low").alias("head_low"))
        jumped = lower.join(heads, F.col("low") == F.col("head"), "left")
        jumped = staged(spark, jumped.select("node", "label", F.coalesce("head_low", "low").alias("low")), "labels")
        if jumped.filter("low != label").isEmpty():
            return labels
        labels = jumped.select("node", F.col("low").alias("label"))
