"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Each source has a weight and a size (its words).  The mix has as many words as all sources together; they
are shared by weight, sources are clamped at ``max_epochs`` times their size, and the excess goes to the
others by weight until none is above.  A source whose target is e times its size has each document
``floor(e)`` times and a seeded part of its documents once more: in the order of a seeded digest, as many
as come nearest to the rest of the target.

Defined cases: a null source is a source of its own and the last in order; a null or empty text has size 0
and is taken 0 times; repeated rows are taken one by one; rows that tie in digest, id and size are
alike in every result column; a null doc_id comes first among ties; an empty table gives an empty result.
Sources are numbered in one task, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlens.llm.common import order_cut, read, staged, words

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, m_source, size, digest`` of every row; sources get a prefix so that null sorts last."""
    return docs.select(*_order(seed))


def _order(seed: str) -> list[Column]:
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return [
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("m_source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), ident)).alias("digest"),
    ]


def targets(rows: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``m_source, source_size, target, whole, need`` per source.

    Sources in the order of cap over weight: if one is above its cap, so are all before it.  The first that
    stays below its share of what the clamped ones leave sets the level for itself and all after it.
    """
    per = rows.groupBy("m_source").agg(F.sum("size").alias("source_size"))
    # UTF-8 order of bytes is the order of code points, null last
    number = F.row_number().over(Window.orderBy("m_source")) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (number % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    total = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "m_source")
    per = (
        per.withColumn("all_words", F.sum("source_size").over(total))
        .withColumn("left", F.col("all_words") - F.sum("cap").over(order) + F.col("cap"))
        .withColumn("open", F.sum("weight").over(total) - F.sum("weight").over(order) + F.col("weight"))
        .withColumn("below", F.col("cap") * F.col("open") > F.col("weight") * F.col("left"))
    )
    level = Window.orderBy(F.col("cap") / F.col("weight"), "m_source").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("at", F.first(F.when(F.col("below"), F.struct("left", "open")), ignorenulls=True).over(level))
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("at.left")).cast("double") / F.col("at.open")
    )
    per = per.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return per.withColumn("whole", whole).select(
        "m_source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need")
    )


def plan_mix(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): the staged sizes of all rows, and per source its target and the first row it leaves out."""
    rows = staged(spark, sizes(docs, seed), "sizes")
    per = staged(spark, targets(rows), "targets")
    cut = order_cut(rows, per, "m_source", "digest", "size", ["doc_id", "size"]).withColumnRenamed("m_source", "c_source")
    plan = per.join(cut, F.col("m_source") == F.col("c_source"), "left").drop("c_source")
    return rows, staged(spark, plan.withColumnRenamed("m_source", "p_source"), "mix-plan")


def _repetitions() -> Column:
    """How often a row (m_source, size, digest, doc_id joined with its source's plan) is taken."""
    same = F.col("digest") == F.col("cut_digest")
    ident = F.coalesce(
        F.when(F.col("doc_id").isNull() & F.col("cut_doc_id").isNull(), F.col("size") < F.col("cut_size")),
        F.when(F.col("doc_id").isNull(), F.lit(True)),
        F.when(F.col("cut_doc_id").isNull(), F.lit(False)),
        (F.col("doc_id") < F.col("cut_doc_id")) | ((F.col("doc_id") == F.col("cut_doc_id")) & (F.col("size") < F.col("cut_size"))),
    )
    early = F.col("cut_digest").isNull() | (F.col("digest") < F.col("cut_digest")) | (same & ident)
    extra = F.when((F.col("need") > 0) & early, 1).otherwise(0)
    return (F.col("whole") + extra).cast("long")


def mix(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs`` (doc_id, text, source)."""
    rows, plan = plan_mix(spark, docs, seed)
    # a staged plan of one row per source: Spark broadcasts it if its files are below the threshold
    return rows.join(plan, F.col("m_source") == F.col("p_source")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _repetitions()).alias("taken")
    )


def mixed_documents(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents as the mix takes them, repeated ones as several rows; documents without words are not taken."""
    _, plan = plan_mix(spark, docs, seed)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("m_row"), *_order(seed))
    rows = rows.join(plan, F.col("m_source") == F.col("p_source")).filter("size > 0")
    rows = rows.withColumn("m_times", _repetitions()).filter("m_times > 0")
    return rows.select("m_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m_times")))).select("m_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, read(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest,
    len([x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']) AS size
  FROM documents
), per AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap, [1, 2, 3][1 + (row_number() OVER (ORDER BY s) - 1) % 3] AS weight
  FROM (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1)
), lv AS (
  SELECT *, CAST(sum(source_size) OVER () - sum(cap) OVER o + cap AS BIGINT) AS rest,
    CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS BIGINT) AS open_weight, row_number() OVER o AS k
  FROM per WINDOW o AS (ORDER BY cap / weight, s ROWS UNBOUNDED PRECEDING)
), first_below AS (
  SELECT k, rest, open_weight FROM lv WHERE cap * open_weight > weight * rest ORDER BY k LIMIT 1
), t AS (
  SELECT s, source_size, CASE WHEN f.k IS NULL OR lv.k < f.k THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * f.rest AS DOUBLE) / f.open_weight END AS target
  FROM lv LEFT JOIN first_below f ON true
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS need,
    sum(size) OVER (PARTITION BY s ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM d JOIN w USING (s)
)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN need > 0 AND middle <= need THEN 1 ELSE 0 END) AS taken
FROM r
"""
