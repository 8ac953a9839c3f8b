"""Scans, staging, payloads, file listings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterlens import sources as s
from meterlens.schemas import DDL, SchemaMismatch, conform, schema
from meterlens.session import scratch_dir


def rows(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("table", [t for t in DDL if t not in ("l_billable_csv", "platform_summary")])
def test_fixture_views_meet_their_schema(tables, table):
    assert conform(tables[table], table).columns == schema(table).fieldNames()


def test_conform_reports_columns_and_types(frame):
    with pytest.raises(SchemaMismatch, match="missing columns"):
        conform(frame([("a",)], "warehouse_name string"), "w_metering")
    with pytest.raises(SchemaMismatch, match="credits_used: string instead of double"):
        conform(frame([], "warehouse_name string, start_time timestamp, credits_used string"), "w_metering")


def test_scan_keeps_only_declared_columns(spark, frame, tmp_path):
    frame([("w", 1.0, "x")], "warehouse_name string, credits_used double, extra string").withColumn(
        "start_time", F.lit("2024-01-01").cast("timestamp")
    ).write.parquet(str(tmp_path / "m"))
    df = s.scan_usage_table(spark, "w_metering", str(tmp_path / "m"))
    assert df.columns == ["warehouse_name", "start_time", "credits_used"]


def test_scan_of_a_catalog_table(spark, frame):
    frame([("c",)], "catalog_name string").createOrReplaceTempView("catalogs_for_test")
    assert rows(s.scan_usage_table(spark, "l_catalogs", "catalogs_for_test", fmt="table")) == [("c",)]


def test_optional_source(spark, frame):
    missing = lambda: spark.read.parquet("/no/such/path")
    with pytest.warns(UserWarning, match="skipping grants"):
        assert s.optional_source(spark, "grants", missing) is None
    with pytest.warns(UserWarning):
        empty = s.optional_source(spark, "grants", missing, empty_as="w_metering")
    assert empty.count() == 0 and empty.columns == schema("w_metering").fieldNames()
    given = frame([(1,)], "a int")
    assert s.optional_source(spark, "x", lambda: given) is given
    with pytest.raises(ZeroDivisionError):
        s.optional_source(spark, "x", lambda: 1 / 0)


def test_stage_round_trip_overwrites(spark, frame, tmp_path):
    one = frame([(1, "a")], "i int, s string")
    for _ in range(2):
        s.stage_write(one, str(tmp_path), "t")
    assert rows(s.stage_read(spark, str(tmp_path), "t", one.schema)) == [(1, "a")]
    assert s.stage_read_optional(spark, str(tmp_path), "absent") is None
    assert rows(s.stage_read_optional(spark, str(tmp_path), "t")) == [(1, "a")]


def test_staged_scalar_keeps_its_values(frame, tmp_path):
    assert rows(s.stage_scalar(frame([(7, None)], "n bigint, x double"), str(tmp_path), "totals")) == [(7, None)]


def test_scratch_dir_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b
    if shared:
        assert a.startswith(shared)


def test_billable_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("timestamp,dbus,dollars\n2024-01-01T00:00:00Z,1.5,2.5\n\n2024-01-02,3,4\n")
    got = [(str(r[0]), r[1], r[2]) for r in s.billable_usage_csv(spark, str(tmp_path / "b.csv")).collect()]
    assert got == [("2024-01-01", 1.5, 2.5), ("2024-01-02", 3.0, 4.0)]
    assert s.billable_usage_csv(spark, str(tmp_path / "none.csv")) is None


def test_missing_summary_names_the_path(spark):
    with pytest.raises(FileNotFoundError, match="/no/such/summary"):
        s.read_summary_json(spark, "/no/such/summary")


def test_summary_json_keeps_nulls(spark, tmp_path):
    row = spark.sql("SELECT 1 AS x").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema("platform_summary")]
    ).withColumn("platform", F.lit("p"))
    s.write_summary_json(row, str(tmp_path / "s"))
    back = s.read_summary_json(spark, str(tmp_path / "s")).collect()
    assert len(back) == 1 and back[0]["platform"] == "p" and back[0]["total_queries"] is None


def test_payload_names(frame):
    payloads = frame(
        [('{"warehouses":[{"id":"1","name":"A"},{"id":"2"}]}',), ("{broken",), ('{"other":1}',), (None,), ('{"warehouses":[]}',)],
        "payload string",
    )
    assert rows(s.endpoint_names(payloads)) == [("1", "A"), ("2", "")]


def test_job_tasks(frame):
    payload = '{"settings":{"tasks":[{"task_key":"k","a":1,"sql_task":{"x":{"inner_task":1}},"dbt_task":{}},{"depends":[]}]}}'
    df = frame([("1", payload), ("2", "nope"), ("3", '{"settings":{}}')], "job_id string, payload string")
    assert rows(s.job_tasks_from_json(df)) == [("1", "", "unknown_task"), ("1", "k", "sql_task")]


def test_file_manifest_lists_sizes_without_reading(spark, tmp_path):
    root = tmp_path / "lake"
    for table, sizes in (("t1", [3, 4]), ("t2", [5])):
        folder = root / "cat" / "sch" / table
        folder.mkdir(parents=True)
        for i, n in enumerate(sizes):
            (folder / f"part-{i}.parquet").write_bytes(b"x" * n)
    manifest = s.scan_file_manifest(spark, str(root))
    assert "content" not in manifest.columns
    tables = spark.createDataFrame(
        [("cat", "sch", "t1", "MANAGED"), ("cat", "sch", "t2", "VIEW"), ("cat", "sch", "t3", "EXTERNAL")],
        "table_catalog string, table_schema string, table_name string, table_type string",
    )
    assert rows(s.table_sizes_from_files(manifest)) == [("cat.sch.t1", "parquet", 2, 7), ("cat.sch.t2", "parquet", 1, 5)]
    assert rows(s.table_sizes_from_files(manifest, tables)) == [("cat.sch.t1", "parquet", 2, 7)]


def test_a_table_of_two_formats_is_one_table(frame):
    files = [("t", "delta", "a", 1), ("t", "delta", "b", 2), ("t", "parquet", "c", 50), ("u", None, "d", None)]
    manifest = frame(files, "qualified_name string, format string, path string, length bigint")
    assert rows(s.table_sizes_from_files(manifest)) == [("t", "delta", 3, 53), ("u", None, 1, 0)]


def test_current_dimensions(spark):
    df = spark.sql("SELECT '1' AS job_id, 'a' AS name, CAST(NULL AS TIMESTAMP) AS delete_time UNION ALL SELECT '2','b',TIMESTAMP'2024-01-01'")
    assert rows(s.job_names(df)) == [("1", "a")]


def test_refusals(spark, tmp_path):
    from meterlens.session import scratch_dir
    from meterlens.sources import billable_usage_csv, scan_usage_table

    with pytest.raises(ValueError, match="numPartitions"):
        scan_usage_table(spark, "w_query_history", "log", "jdbc", url="jdbc:none")
    (tmp_path / "swapped.csv").write_text("timestamp,dollars,dbus\n2024-01-01,1.5,2.5\n")
    with pytest.raises(Exception, match="CSV header"):
        billable_usage_csv(spark, str(tmp_path / "swapped.csv")).collect()

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod({"spark.master": "spark://host:7077"}.get)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(Cluster(), "x")


# ---- table logs ----------------------------------------------------------------

LOG = "qualified_name string, format string, version bigint, action string, path string, length bigint"


def _replayed(log, upto=None):
    """The log one action after the other, adds of a version behind its removes."""
    live = {}
    for table, fmt, version, action, path, length in sorted(log, key=lambda a: (a[2], a[3] == "add")):
        if upto is None or version <= upto:
            if action == "add":
                live[table, fmt, path] = length or 0
            else:
                live.pop((table, fmt, path), None)
    return sorted((*key, length) for key, length in live.items())


def test_live_files_are_those_of_a_replay(frame):
    rng = random.Random(11)
    log = [("c.s.hot" if rng.random() < 0.4 else f"c.s.t{rng.randrange(4)}", "delta", version, action, f"p{rng.randrange(12)}", None)
           for version in range(300) for action in rng.sample(["add", "remove"], rng.randint(1, 2))]
    log = [(*a[:5], 1000 * a[2] + 7 if a[3] == "add" else None) for a in {(a[0], a[2], a[3], a[4]): a for a in log}.values()]
    df = frame(log, LOG)
    for upto in (None, 0, 57, 299):
        assert rows(s.live_files(df, upto)) == _replayed(log, upto)
    live = _replayed(log)
    totals = sorted((t, "delta", sum(x[0] == t for x in live), sum(x[3] for x in live if x[0] == t)) for t in {x[0] for x in live})
    assert rows(s.table_sizes_from_files(s.live_files(df))) == totals


def test_files_removed_added_again_and_replaced(frame):
    log = [
        ("t", "delta", 0, "add", "gone", 1), ("t", "delta", 1, "remove", "gone", None),
        ("t", "delta", 0, "add", "back", 2), ("t", "delta", 1, "remove", "back", None), ("t", "delta", 2, "add", "back", 3),
        ("t", "delta", 3, "remove", "marked", None), ("t", "delta", 3, "add", "marked", 5), ("t", "delta", 0, "add", "marked", 4),
        ("t", "delta", 9, "remove", "never added", None), ("t", "delta", 4, "add", "no size", None), ("u", "delta", 1, "remove", "only removed", None),
    ]
    df = frame(log, LOG)
    assert rows(s.live_files(df)) == [("t", "delta", "back", 3), ("t", "delta", "marked", 5), ("t", "delta", "no size", 0)]
    assert rows(s.table_sizes_from_files(s.live_files(df, 0))) == [("t", "delta", 3, 7)]
    assert rows(s.live_files(frame([], LOG))) == []


def test_the_replay_hashes_and_combines_before_it_shuffles(frame):
    plan = s.live_files(frame([("t", "delta", 0, "add", "p", 1)], LOG))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1


def test_logs_are_read_from_commits_and_checkpoints(spark, tmp_path):
    root = tmp_path / "lake"
    commits = {
        "t 1+": {
            3: [{"commitInfo": {"operation": "WRITE"}}, {"add": {"path": "a", "size": 3, "partitionValues": {}}}, {"add": {"path": "b", "size": 4}}],
            4: [{"remove": {"path": "a", "deletionTimestamp": 1}}, {"add": {"path": "c", "size": 5}}],
        },
        "t2": {11: [{"remove": {"path": "old1"}}, {"add": {"path": "new", "size": 9}}]},
    }
    for table, versions in commits.items():
        log = root / "cat" / "sch" / table / "_delta_log"
        log.mkdir(parents=True)
        (log.parent / "part-0.parquet").write_bytes(b"not a log")
        for version, actions in versions.items():
            (log / f"{version:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    # older commits of t2 are gone, its checkpoint holds what they left
    checkpoint = root / "cat" / "sch" / "t2" / "_delta_log" / f"{10:020d}.checkpoint.parquet"
    state = spark.createDataFrame([(("old1", 1), None), (("old2", 2), None), (None, ("long ago",))], "add struct<path: string, size: bigint>, remove struct<path: string>")
    state.coalesce(1).write.parquet(str(tmp_path / "state"))
    next((tmp_path / "state").glob("part-*.parquet")).rename(checkpoint)
    log = s.scan_table_log(spark, str(root))
    assert log.schema.simpleString() == spark.createDataFrame([], LOG).schema.simpleString()
    assert rows(s.live_files(log)) == [("cat.sch.t 1+", "delta", "b", 4), ("cat.sch.t 1+", "delta", "c", 5), ("cat.sch.t2", "delta", "new", 9), ("cat.sch.t2", "delta", "old2", 2)]
    assert rows(s.table_sizes_from_files(s.live_files(log, 3))) == [("cat.sch.t 1+", "delta", 2, 7)]
