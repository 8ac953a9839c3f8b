"""Column expressions on edge values."""

import pytest
from pyspark.sql import functions as F

from meterlens import functions as f

DOMAIN = "corp.example"


@pytest.fixture
def each(spark):
    """Evaluate one expression over a list of values, in order."""

    def run(values, expr, kind="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        return [r["out"] for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_lookback_is_inclusive_at_the_cut_off(spark, kind):
    df = spark.sql(
        f"SELECT CAST(x AS {kind}) AS ts FROM VALUES ('2024-01-10 23:59:59.999'), ('2024-01-11 00:00:00'), ('2024-02-01') AS t(x)"
    )
    assert df.filter(f.lookback_ts("ts", "2024-01-31", 20)).count() == 1
    assert df.filter(f.lookback_ts("ts", "2024-02-01 00:00:01", 22)).count() == 3


def test_lookback_date_ignores_the_time_of_as_of(spark):
    df = spark.sql("SELECT DATE'2024-01-10' AS d UNION ALL SELECT DATE'2024-01-11'")
    assert df.filter(f.lookback_date("d", "2024-01-31 17:30:00", 20)).count() == 1


def test_lookback_ts_keeps_the_time_of_as_of(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-11 11:00:00' AS ts UNION ALL SELECT TIMESTAMP'2024-01-11 13:00:00'")
    assert df.filter(f.lookback_ts("ts", "2024-01-31 12:00:00", 20)).count() == 1


def test_months_between():
    assert f.months_between("2001-02-10", 45) == ["2000-12", "2001-01", "2001-02"]
    assert f.months_between("2001-02-10", 0) == ["2001-02"]
    assert len(f.months_between("2001-08-02", 365)) == 13


def test_day_and_month(each):
    assert each(["2024-03-05 23:59:59", None], lambda c: f.day_of(c.cast("timestamp"))) == ["2024-03-05", None]
    assert each(["2024-03-05"], lambda c: f.month_of(c.cast("date"))) == ["2024-03"]


def test_actor_type(each):
    assert each(["a@b", "uuid", "", None], f.actor_type) == ["person", "service", "service", "service"]


def test_is_employee(each):
    names = ["A@Corp.Example", "a@corp.example.org", "a@notcorp.example", None]
    assert each(names, lambda c: f.is_employee(c, DOMAIN)) == [True, False, False, False]


def test_classify_user_type(spark):
    rows = [("x", "LEGACY_SERVICE"), ("a@corp.example", ""), ("a@corp.example", "  "), ("x", None), (None, None)]
    df = spark.createDataFrame(rows, "n string, t string")
    got = [r[0] for r in df.select(f.classify_user_type("n", "t", DOMAIN)).collect()]
    assert got == ["LEGACY_SERVICE", "PERSON", "PERSON", "Unclassified", "Unclassified"]
    flags = [r[0] for r in df.select(f.is_service_account("n", "t", DOMAIN)).collect()]
    assert flags == [True, False, False, False, False]


def test_bucket_and_display(spark):
    df = spark.createDataFrame([("U@corp.example", "known"), ("id", "known"), ("id", None), (None, None)], "a string, k string")
    got = [tuple(r) for r in df.select(f.bucket_people("a", DOMAIN, "E"), f.display_name("a", "k", DOMAIN, "E")).collect()]
    assert got == [("E", "E"), ("id", "known"), ("id", "id"), (None, None)]


def test_compute_name(spark):
    rows = [("w", "W", None, None), ("w", None, "c", "C"), (None, None, "c", "C"), (None, None, "c", None), (None, "W", None, "C")]
    df = spark.createDataFrame(rows, "w string, wn string, c string, cn string")
    got = [r[0] for r in df.select(f.compute_name("w", "wn", "c", "cn", F.lit("TYPE"))).collect()]
    assert got == ["W", "w", "C", "c", "TYPE"]


def test_base_client_name(each):
    raw = [" JDBC 3.27.1", "Driver v4.6.0-b2", "SQLAPI", "Go 1.2 Client", "Py3 Tool", "Tool  2024.1", "   ", "", None]
    want = ["JDBC", "Driver", "SQLAPI", "Go 1.2 Client", "Py3 Tool", "Tool", "Unknown", "Unknown", "Unknown"]
    assert each(raw, f.base_client_name) == want


def test_classify_statement(each):
    raw = ["call p()", "  Execute Immediate x", "execute task", "COPY INTO t", "selectx", "  ", None, "truncate t", "alter t", "create t"]
    want = [
        "Stored Procedure Call", "EXECUTE IMMEDIATE", "Other SQL", "COPY INTO", "Other SQL", "Unknown", "Unknown",
        "TRUNCATE", "ALTER", "CREATE",
    ]
    assert each(raw, f.classify_statement) == want


def test_friendly_task_type(each):
    raw = ["spark_jar_task", "dbt_task", "clean_rooms_notebook_task", "newThing_task", "plain", "unknown_task", "a__b_task"]
    assert each(raw, f.friendly_task_type) == ["JAR", "dbt", "Clean Rooms Notebook", "NewThing", "Plain", "Unknown", "A  B"]


def test_error_class(each):
    raw = ["[DIV_BY_0] x", "[mixedCase] x", "x [LATE]", "PERMISSION_DENIED: x", "", None]
    assert each(raw, f.error_class) == ["DIV_BY_0", "OTHER", "OTHER", "OTHER", "OTHER", "OTHER"]


def test_sample_message(each):
    assert each(["x" * 200, None, "abc"], f.sample_message) == ["x" * 160, "", "abc"]


def test_not_internal_schema(each):
    assert each(["__x", "_x", "x__", None], f.not_internal_schema) == [False, True, True, True]


def test_default_label_and_flags(each):
    assert each(["", None, "x"], f.default_label) == ["", "Unknown", "x"]
    assert each(["", None, "x"], lambda c: f.default_label(c, "(none)", blank_too=True)) == ["(none)", "(none)", "x"]
    assert each(["YES", "yes", "No", "TRUE", "false", None], f.yes_no_to_bool) == [True, True, False, True, False, False]


def test_policy_options(each):
    raw = ['{"ARCHIVE_TIER":"COLD","ARCHIVE_FOR_DAYS":90}', '{"ARCHIVE_FOR_DAYS":"7"}', '{"ARCHIVE_FOR_DAYS":"x"}', "no json", None]
    assert each(raw, lambda c: f.policy_options(c)[0]) == ["COLD", "Unknown", "Unknown", "Unknown", "Unknown"]
    assert each(raw, lambda c: f.policy_options(c)[1]) == [90, 7, 0, 0, 0]


def test_ipv4(each):
    raw = ["0.0.0.0", "255.255.255.255", "10.0.1.2", "1.2.3", "1.2.3.4.5", "256.1.1.1", "-1.2.3.4", "a.b.c.d", " 1.2.3.4", "::1", "", None]
    assert each(raw, f.ipv4_to_long) == [0, 2**32 - 1, (10 << 24) + 258, *[None] * 9]


def test_cidr(each):
    raw = ["0.0.0.0/0", "10.1.2.3/24", "10.1.2.3", "10.1.2.3/32", "10.1.2.3/33", "10.1.2.3/x", "bad/8", None]
    base = (10 << 24) + (1 << 16) + (2 << 8)
    low = [0, base, base + 3, base + 3, None, None, None, None]
    high = [2**32 - 1, base + 255, base + 3, base + 3, None, None, None, None]
    assert each(raw, lambda c: f.cidr_range(c)[0]) == low
    assert each(raw, lambda c: f.cidr_range(c)[1]) == high


def test_cross_region(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('aws','r','aws','r'), ('aws','r','gcp','r'), ('aws','r','aws','s'), ('aws','r',NULL,'r'), (NULL,'r',NULL,'r')"
        " AS t(a,b,c,d)"
    )
    assert [r[0] for r in df.select(f.cross_region_flag("a", "b", "c", "d")).collect()] == [False, True, True, True, False]


def test_guards_and_units(spark):
    row = spark.sql("SELECT 5 AS a, 2 AS b, 0 AS z, CAST(NULL AS INT) AS n")
    got = row.select(
        f.safe_ratio("a", "b"), f.safe_ratio("a", "z"), f.safe_ratio("a", "n"), f.safe_percent("a", "b"), f.safe_percent("a", "z"),
        f.bytes_to_gb(F.lit(1024**3)), f.ms_to_seconds("a"), f.seconds_to_hours(F.lit(7200)), f.per_tb_to_per_gb(F.lit(2048.0)),
    ).collect()[0]
    assert tuple(got) == (2.5, 0.0, 0.0, 250.0, 0.0, 1.0, 0.005, 2.0, 2.0)


def test_sums_of_nothing_are_zero(spark):
    empty = spark.sql("SELECT CAST(NULL AS BIGINT) AS x, CAST(NULL AS DOUBLE) AS d WHERE FALSE")
    assert tuple(empty.agg(f.sum_long("x"), f.sum_double("d"), f.count_where(F.col("x") > 0)).collect()[0]) == (0, 0.0, 0)


def test_skus_and_adjustments(each):
    assert each(["X_COMPUTE_Y", "compute", None], f.is_compute_sku) == [True, False, None]
    assert each(["Adj for x", "storage", None], f.is_adjustment) == [True, False, False]


def test_lookback_ends_before_as_of(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-06-30')) AS d").selectExpr("d", "CAST(d AS TIMESTAMP) AS ts")
    window = f.Lookback("2024-01-31", 30)
    assert df.filter(window.ts("ts")).count() == df.filter(window.date("d")).count() == 30
    noon = f.Lookback("2024-01-31 12:00:00", 30)
    assert df.filter(noon.date("d")).count() == 31 and noon.months() == ["2024-01"]
    assert f.Lookback("2024-02-01", 31).months() == ["2024-01"]


def test_money_does_not_depend_on_partitions(spark):
    df = spark.range(2_000_000).selectExpr("CAST(rand(7) * 1e5 AS DOUBLE) AS x", "id")
    df = df.selectExpr("CAST(id * 0.1 + pmod(id * 7919, 100003) / 7.0 AS DOUBLE) AS x")
    assert len({df.repartition(n).agg(f.sum_double("x", None).alias("s")).first()["s"] for n in (4, 7, 64)}) == 1


def test_qualified_name_with_a_gap_is_null(spark):
    df = spark.sql("SELECT 'c' AS a, CAST(NULL AS STRING) AS b, 't' AS c")
    assert df.select(f.qualified_name("a", "b", "c"), f.qualified_name("a", "c")).first()[:] == (None, "c.t")
