"""Quality rules with cross-document line frequency, in DataFrame operations only.

A line is normalised (lower case, digits to 0, white space squeezed) and hashed together with its host.
Its frequency is the number of distinct documents of that host that contain it, where documents of equal
text count as one, so that plain copies do not turn each other's prose into boilerplate.  Lines above
``max(min_docs, share of the host's distinct documents)`` are removed; a document that keeps less than
half of its words is depleted and rejected, as is one that fails the base rules.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its
own; repeated rows each get the same verdict; a null doc_id is kept as such; other columns are ignored
by ``quality_verdicts`` and passed through by ``quality_filter``; an empty table gives an empty result.
Line hashes have 64 bits: two different lines of one host meet with a chance of 5e-20 a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import SPACE, bind, read, staged, words

MIN_WORDS = 50
MIN_DOCS = 10
HOST_SHARE = 0.01
SYMBOLS = r"[#*$%&|<>]"


def _repeats(rows: DataFrame) -> DataFrame:
    """Words in three-word windows that occur at least twice: ``n_repeat_words`` from ``q_words``.

    Windows become 64-bit hashes.  Only where some are equal, (hash, position) pairs are packed into longs
    and sorted; equal neighbours are the repeated windows, and their positions merge into covered words.
    """
    w = F.col("q_words")
    rows = bind(
        rows,
        q_hash=F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        ),
        q_bits=F.ceil(F.log2(F.size(w) + 2.0)).cast("int"),
    )
    h, bits = F.col("q_hash"), F.col("q_bits")
    packed = F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long")))
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    rows = bind(rows, q_sorted=F.when(repeated, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    s = F.col("q_sorted")

    def high(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    equal = F.filter(s, lambda x, i: (high(x) == high(F.get(s, i - 1))) | (high(x) == high(F.get(s, i + 1))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    rows = bind(rows, q_at=F.sort_array(F.transform(equal, lambda x: x.bitwiseAND(mask))))
    at = F.col("q_at")
    spans = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.get(at, i + 1) - p))
    return rows.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, b: a + b))


def base_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, q_host, q_text_hash`` and the base figures of every row, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", _host().alias("q_host"), F.xxhash64(text).alias("q_text_hash"), text.alias("q_text"))
    rows = bind(
        rows,
        q_words=words(F.col("q_text")),
        q_lines=F.filter(F.split("q_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        n_symbols=F.regexp_count("q_text", F.lit(SYMBOLS)).cast("long"),
    )
    rows = rows.select(
        "doc_id", "q_host", "q_text_hash", "q_words", "n_symbols",
        F.size("q_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = _repeats(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "q_host", "q_text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed")
    )


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def _normal(line: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(F.lower(line), SPACE + "+", " "))
    return F.regexp_replace(squeezed, "[0-9]", "0")


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: ``doc_id, q_host, q_text_hash, line_no, line_hash, line_words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", _host().alias("q_host"), F.xxhash64(text).alias("q_text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "q_line")
    )
    rows = bind(rows, q_norm=_normal(F.col("q_line"))).filter("q_norm != ''")
    gaps = F.char_length("q_norm") - F.char_length(F.replace("q_norm", F.lit(" "), F.lit("")))
    return rows.select(
        "doc_id", "q_host", "q_text_hash", "line_no", F.xxhash64("q_host", "q_norm").alias("line_hash"), (gaps + 1).cast("long").alias("line_words")
    )


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """Lines above the limits: ``line_hash, n_docs``.  Counting is pre-aggregated per task at each step."""
    held = lines.groupBy("line_hash", "q_host", "q_text_hash").agg(F.lit(1).cast("long").alias("one"))
    counts = held.groupBy("line_hash", "q_host").agg(F.sum("one").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = lines.groupBy("q_host", "q_text_hash").agg(F.lit(1).cast("long").alias("one"))
    hosts = hosts.groupBy("q_host").agg(F.sum("one").alias("host_docs"))
    return counts.join(hosts, "q_host").filter(F.col("n_docs") > host_share * F.col("host_docs")).select("line_hash", "n_docs")


def _verdicts(spark: SparkSession, docs: DataFrame, min_docs: int, host_share: float) -> DataFrame:
    lines = staged(spark, line_rows(docs), "lines")
    frequent = frequent_lines(lines, min_docs, host_share)
    key = ["doc_id", "q_host", "q_text_hash"]
    # as a set by place in the text, so that repeated rows count each line once
    gone = lines.join(frequent, "line_hash").groupBy(*[F.col(k).alias(f"g_{k}") for k in key])
    gone = gone.agg(F.collect_set(F.struct("line_no", "line_words", "line_hash")).alias("gone"))
    gone = gone.select(
        *[f"g_{k}" for k in key],
        F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["line_words"]).alias("gone_words"),
        F.array_distinct(F.col("gone.line_hash")).alias("gone_lines"),
    )
    rows = base_rules(docs)
    same = F.col("doc_id").eqNullSafe(F.col("g_doc_id")) & (F.col("q_host") == F.col("g_q_host")) & (F.col("q_text_hash") == F.col("g_q_text_hash"))
    rows = rows.join(gone, same, "left").withColumn("removed_words", F.coalesce("gone_words", F.lit(0).cast("long")))
    depleted = 2 * F.col("removed_words") > F.col("n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_verdicts(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """Base figures and the verdict of every row of ``docs`` (doc_id, text, source)."""
    return _verdicts(spark, docs, min_docs, host_share).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def quality_filter(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """The kept documents, without their lines above the limits; ``n_chars``, if there, follows the text."""
    verdicts = _verdicts(spark, docs, min_docs, host_share).filter("kept")
    keys = ("doc_id", "q_host", "q_text_hash")
    verdicts = verdicts.groupBy(*keys).agg(F.first("gone_lines").alias("q_gone"))  # repeated rows: one verdict
    rows = docs.select("*", _host().alias("q_host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("q_text_hash"))
    right = verdicts.select(*[F.col(k).alias(f"v_{k}") for k in keys], "q_gone")
    same = [rows[k].eqNullSafe(right[f"v_{k}"]) for k in keys]
    rows = rows.join(right, same)
    left = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains("q_gone", F.xxhash64("q_host", _normal(line))))
    rows = rows.withColumn("text", F.when(F.col("q_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark, read(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS text,
    [x FOR x IN string_split_regex(coalesce(text, ''), '{SPACE}+') IF x <> ''] AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents
), base AS (
  SELECT doc_id, host, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM d
), tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM hit) GROUP BY 1
), ln AS (
  SELECT doc_id, host, text, regexp_replace(trim(regexp_replace(lower(l), '{SPACE}+', ' ', 'g')), '[0-9]', '0', 'g') AS norm
  FROM (SELECT doc_id, host, text, unnest(lines) AS l FROM d)
), freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM ln GROUP BY 1, 2)
  JOIN (SELECT host, count(DISTINCT text) AS host_docs FROM ln GROUP BY 1) USING (host)
  WHERE n > {MIN_DOCS} AND n > {HOST_SHARE} * host_docs
), gone AS (
  SELECT doc_id, sum(len(string_split(norm, ' '))) AS removed_words FROM ln JOIN freq USING (host, norm) GROUP BY 1
), all_of AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(removed_words, 0) AS removed_words
  FROM base b LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept,
  CAST(removed_words AS BIGINT) AS removed_words
FROM all_of
"""
