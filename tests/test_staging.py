"""Stages: completeness, windows, days, buckets, published summaries."""

import json
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fixtures.cases.compare import GENERATED
from fixtures.cases.registry import OR
from meterlens.functions import Lookback
from meterlens.operators import access, activity, automation
from meterlens.plans import published as p
from meterlens.plans.incremental import DailyStages
from meterlens.plans.settings import StageMismatch, no_stage, stage_to
from meterlens.schemas import schema
from meterlens.sources import read_summary_json, stage_read_optional, stage_write, write_summary_json
from meterlens.sources.staging import RECORD, read_record, stage_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def numbers(spark):
    return spark.range(5).select(F.col("id").alias("n"), F.lit("x").alias("x"))


# ---- completeness ---------------------------------------------------------------


def test_a_killed_write_counts_as_never_staged(spark, numbers, tmp_path):
    left = Path(stage_path(str(tmp_path), "t")) / "_temporary" / "0"
    left.mkdir(parents=True)
    assert stage_read_optional(spark, str(tmp_path), "t") is None
    assert rows(stage_to(str(tmp_path), resume=True)("t", numbers)) == rows(numbers)
    assert rows(stage_read_optional(spark, str(tmp_path), "t")) == rows(numbers)


def test_files_without_a_finished_job_are_written_anew(spark, numbers, tmp_path):
    stage_write(numbers, str(tmp_path), "t")
    folder = Path(stage_path(str(tmp_path), "t"))
    for mark in ("_SUCCESS", RECORD):
        (folder / mark).unlink()
    for part in list(folder.glob("part-*"))[:1]:
        part.unlink()
    assert stage_read_optional(spark, str(tmp_path), "t") is None
    assert rows(stage_to(str(tmp_path), resume=True)("t", numbers)) == rows(numbers)


def test_an_empty_stage_is_complete(spark, numbers, tmp_path):
    stage_write(numbers.limit(0), str(tmp_path), "t")
    assert stage_read_optional(spark, str(tmp_path), "t", numbers.schema).count() == 0
    assert stage_to(str(tmp_path), resume=True)("t", numbers).count() == 0


def test_a_stage_of_another_window_or_schema_is_refused(numbers, tmp_path):
    window = Lookback("2024-01-31", 30)
    stage_to(str(tmp_path))("t", numbers, window)
    resumed = stage_to(str(tmp_path), resume=True)
    assert rows(resumed("t", numbers.limit(0), window)) == rows(numbers)
    for other in (Lookback("2024-02-01", 30), Lookback("2024-01-31", 29), None):
        with pytest.raises(StageMismatch, match="30 days before 2024-01-31"):
            resumed("t", numbers, other)
    with pytest.raises(StageMismatch, match="columns"):
        resumed("t", numbers.withColumn("n", F.col("n").cast("int")), window)
    # without resume it is simply replaced
    assert rows(stage_to(str(tmp_path))("t", numbers.limit(2), None)) == rows(numbers.limit(2))


# ---- days -----------------------------------------------------------------------


class Log:
    """A growing query log; remembers the windows it was folded over."""

    def __init__(self, spark):
        self.spark, self.rows, self.windows = spark, [], []

    def add(self, *stamps, user="u"):
        self.rows += [(f"q{len(self.rows) + k}", datetime.fromisoformat(s), user) for k, s in enumerate(stamps)]

    def fold(self, window):
        df = self.spark.createDataFrame(self.rows, "query_id string, start_time timestamp, user_name string")
        columns = {f.name: F.lit(None).cast(f.dataType) for f in schema("w_query_history") if f.name not in df.columns}
        self.windows.append(window)
        return activity.w_query_cube(df.withColumns(columns), window)


@pytest.fixture
def log(spark):
    log = Log(spark)
    log.add(*(f"2024-01-{d:02d} {h:02d}:30:00" for d in range(1, 20) for h in (0, 5, 22, 23)))
    return log


def test_a_later_report_reads_the_new_day_and_the_lag(log, tmp_path):
    stages = DailyStages(str(tmp_path))
    first = Lookback("2024-01-11", 8)
    assert rows(stages.days("cube", log.fold, first)) == rows(log.fold(first))
    # late rows of the last day, and a row of a settled day that must not be looked for
    log.add("2024-01-10 22:59:00", "2024-01-10 23:59:59", user="late")
    log.windows.clear()
    later = Lookback("2024-01-12", 8)
    got = stages.days("cube", log.fold, later)
    assert log.windows[-1] == Lookback("2024-01-12", 2)
    assert rows(got) == rows(log.fold(later))
    assert read_record(log.spark, stage_path(str(tmp_path), "cube"))["first"] == "2024-01-03"
    # the same report again: the lag of its own end only
    log.windows.clear()
    assert rows(stages.days("cube", log.fold, later)) == rows(log.fold(later))
    assert log.windows[1] == Lookback("2024-01-12", 1)


def test_windows_that_are_not_covered_are_computed_whole(log, tmp_path):
    stages = DailyStages(str(tmp_path), lag=timedelta(0))
    stages.days("cube", log.fold, Lookback("2024-01-11", 4))
    for window in (Lookback("2024-01-11", 9), Lookback("2024-01-19", 2), Lookback("2024-01-05", 3)):
        assert rows(stages.days("cube", log.fold, window)) == rows(log.fold(window))
    # an earlier report within the covered days computes nothing
    stages.days("cube", log.fold, Lookback("2024-01-19", 15))
    log.windows.clear()
    inner = Lookback("2024-01-12", 5)
    assert rows(stages.days("cube", log.fold, inner)) == rows(log.fold(inner))
    assert log.windows[0] == inner and len(log.windows) == 2


def test_a_killed_update_is_repeated(log, tmp_path):
    stages = DailyStages(str(tmp_path))
    stages.days("cube", log.fold, Lookback("2024-01-11", 8))
    folder = Path(stage_path(str(tmp_path), "cube"))
    # the update removed a day and wrote half of another, and never got to its record
    for part in (folder / "day=2024-01-10").glob("*"):
        part.unlink()
    (folder / "day=2024-01-10").rmdir()
    (folder / ".spark-staging-1").mkdir()
    later = Lookback("2024-01-12", 8)
    assert rows(stages.days("cube", log.fold, later)) == rows(log.fold(later))


def test_another_rollup_under_the_name_is_computed_anew(log, tmp_path):
    stages = DailyStages(str(tmp_path), files_per_day=3)
    window = Lookback("2024-01-11", 8)
    stages.days("cube", log.fold, window)
    narrow = lambda w: log.fold(w).groupBy("day").agg(F.sum("query_count").alias("n"))
    assert rows(stages.days("cube", narrow, window)) == rows(narrow(window))
    with pytest.raises(ValueError, match="midnight"):
        stages.days("cube", log.fold, Lookback("2024-01-11 12:00:00", 8))


def test_an_empty_log_has_an_empty_cube(log, tmp_path):
    window = Lookback("2020-01-11", 8)
    got = DailyStages(str(tmp_path)).days("cube", log.fold, window)
    assert got.count() == 0 and got.columns == log.fold(window).columns


def test_the_days_to_compute_reach_the_scan(spark, tables, tmp_path):
    """Of a log on disk only the new days are read."""
    path = str(tmp_path / "runs")
    tables["l_job_runs"].write.parquet(path)
    runs = spark.read.parquet(path)
    seen = []

    def fold(window):
        seen.append(automation.l_job_cube(runs, window).withColumn("day", F.date_format("day", "yyyy-MM-dd")))
        return seen[-1]

    end = datetime.fromisoformat(OR.as_of)
    stages = DailyStages(str(tmp_path / "stages"))
    stages.days("jobs", fold, Lookback((end - timedelta(days=1)).date().isoformat(), OR.days))
    got = stages.days("jobs", fold, Lookback(OR.as_of, OR.days - 1))
    pushed = re.search(r"PushedFilters: \[([^\n]*)", plan_of(seen[-1])).group(1)
    assert f"GreaterThanOrEqual(period_start_time,{(end - timedelta(days=2)).date()}" in pushed
    assert rows(got) == rows(fold(Lookback(OR.as_of, OR.days - 1)))


# ---- buckets ----------------------------------------------------------------------


def test_distinct_queries_of_a_bucketed_table_shuffle_no_events(spark, tables, tmp_path):
    events = access.access_events(tables["w_access_history"], Lookback("2001-09-15", 365))
    plain = no_stage.keyed("access_events", events, "query_id")
    staged = stage_to(str(tmp_path)).keyed("access_events", events, "query_id")
    assert rows(staged) == rows(plain)
    grains = [["object_name"], ["object_name", "user_name", "action"], ["user_name", "action"]]
    for grain in grains:
        counts = access.distinct_queries(staged, *grain)
        assert rows(counts) == rows(access.distinct_queries(events, *grain))
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(access.distinct_queries(staged, *grain)))
        assert len(dealt) == 1 and "query_id" not in dealt[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        detail = access.w_table_access_detail(tables["w_table_storage"], staged, "corp.example", "Employees")
        assert "query_id" not in " ".join(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(detail)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---- published summaries ------------------------------------------------------------


@pytest.fixture
def summary(spark):
    def build(**changes):
        values = {f.name: None for f in schema("platform_summary")} | {"platform": "p", "lookback_days": 9} | changes
        return spark.createDataFrame([tuple(values.values())], schema("platform_summary"))

    return build


def test_a_summary_is_built_once(spark, summary, tmp_path):
    built = []

    def build():
        built.append(1)
        return summary(total_queries=len(built))

    for _ in range(3):
        got = p.published_or(spark, str(tmp_path), "p", 9, GENERATED, build)
        assert got.collect()[0].total_queries == 1
    assert p.published(spark, str(tmp_path), "p", 10, GENERATED) is None
    assert p.published(spark, str(tmp_path), "p", 9, "2024-01-31T00-00-00Z") is None, "another time of the same look"
    assert p.publish(summary(total_queries=7), str(tmp_path), "p", 9, GENERATED).collect()[0].total_queries == 7
    folder = tmp_path / f"{p.summary_key('p', 9, GENERATED)}.json"
    (folder / "_SUCCESS").unlink()
    p.published_or(spark, str(tmp_path), "p", 9, GENERATED, build)
    assert len(built) == 2, "what a killed write left is built anew"


def test_comparison_of_two_paths(spark, summary, tmp_path):
    paths = [str(tmp_path / side) for side in ("w", "l")]
    for path, days in zip(paths, (90, 30), strict=True):
        write_summary_json(summary(lookback_days=days), path)
    both = p.stored_comparison(spark, *paths)
    assert both["lookback_mismatch"].collect()[0].mismatch
    assert set(both) == {"lookback_mismatch", "migration_projection", "projection_delta", "comparison_table"}
    with pytest.raises(FileNotFoundError):
        p.stored_comparison(spark, paths[0], str(tmp_path / "absent"))
    assert json.loads(next((tmp_path / "w").glob("part-*")).read_text())["lookback_days"] == 90
    assert read_summary_json(spark, paths[0]).count() == 1


@pytest.mark.parametrize("key", ["lookback_mismatch", "migration_projection", "projection_delta", "comparison_table"])
def test_comparisons_share_one_pair_and_read_no_log(spark, key):
    """Whichever comes first publishes the pair; none has a log in its plan."""
    from __spark_entry__ import queries
    from fixtures.cases import compare as cases

    text = plan_of(queries()[key](spark, "/root/testdata/sf0.001"))
    assert len(re.findall("FileScan json", text)) == 2 and "Scan parquet" not in text
    before = {f: f.stat().st_mtime_ns for f in Path(cases.STORES[spark.sparkContext.applicationId]).rglob("*.json")}
    queries()[key](spark, "/root/testdata/sf0.001").collect()
    assert before == {f: f.stat().st_mtime_ns for f in Path(cases.STORES[spark.sparkContext.applicationId]).rglob("*.json")}
