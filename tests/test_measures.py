"""Measures on small inputs whose answer is known, and identities between measures."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fixtures.cases.cost import bill, priced
from fixtures.cases.registry import EV, LI
from fixtures.views import DOMAIN, EMPLOYEES
from meterlens.functions import Lookback
from meterlens.operators import access, activity, automation, cost, logins, storage, users
from meterlens.operators.lookup import attach
from meterlens.sources import principal_names, user_types

WINDOW = Lookback("2024-02-01", 31)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=lambda t: [(v is not None, v) for v in t])


def total(df, column):
    return df.agg(F.sum(column)).collect()[0][0]


# ---- prices ------------------------------------------------------------------


def _usage(frame, stamps):
    df = frame([(s[:10], s, "sku", "p", 2.0, ("who",)) for s in stamps],
               "d string, ts string, sku_name string, billing_origin_product string, usage_quantity double, identity_metadata struct<run_as:string>")
    return df.withColumns({"usage_date": F.to_date("d"), "usage_start_time": F.to_timestamp("ts")})


def _prices(frame, intervals):
    df = frame([("sku", a, b, (p,)) for a, b, p in intervals],
               "sku_name string, a string, b string, pricing struct<default:double>")
    return df.withColumns({"price_start_time": F.to_timestamp("a"), "price_end_time": F.to_timestamp("b")})


def test_price_interval_edges(frame):
    usage = _usage(frame, ["2024-01-01 00:00:00", "2024-01-10 00:00:00", "2024-01-09 23:59:59", "2024-01-20 00:00:00"])
    prices = _prices(frame, [("2024-01-01", "2024-01-10", 1.0), ("2024-01-10", None, 3.0)])
    expected = [("2024-01-01", 2.0), ("2024-01-09", 2.0), ("2024-01-10", 6.0), ("2024-01-20", 6.0)]
    for got in (cost.priced_usage(usage, prices, WINDOW), cost.l_cost_rollup(usage, prices, WINDOW, "usage_date")):
        assert rows(got.select(F.col("usage_date").cast("string"), F.col("usd").cast("double"))) == expected


def test_usage_without_price_drops_and_extra_keys_apply(frame):
    usage = _usage(frame, ["2024-01-05 00:00:00"]).withColumn("cloud", F.lit("a"))
    later = _prices(frame, [("2024-01-06", None, 1.0)])
    assert cost.priced_usage(usage, later, WINDOW).count() == 0
    two = _prices(frame, [("2024-01-01", None, 1.0), ("2024-01-01", None, 5.0)]).withColumn(
        "cloud", F.when(F.col("pricing.default") > 2, "a").otherwise("b")
    )
    assert [r.usd for r in cost.priced_usage(usage, two, WINDOW, extra_keys=["cloud"]).collect()] == [10.0]


def test_priced_usage_has_at_most_one_row_per_usage(tables):
    usage = tables["l_usage"].filter(LI.date("usage_date"))
    assert 0 < cost.priced_usage(tables["l_usage"], tables["l_list_prices"], LI).count() < usage.count()


def test_cost_identities(tables):
    p = cost.priced_usage(tables["l_usage"], tables["l_list_prices"], LI)
    whole = total(p, "usd")
    for df in (cost.l_daily_cost(p), cost.l_cost_by_sku(p), cost.l_monthly_cost_by_sku(p), cost.l_daily_cost_by_product(p)):
        assert total(df, "usd") == pytest.approx(whole)
    folded = priced(tables)
    assert rows(cost.l_cost_by_sku(folded)) == rows(cost.l_cost_by_sku(p))
    by_user = cost.l_user_cost(p, principal_names(tables["l_principals"]), DOMAIN, EMPLOYEES)
    assert total(cost.l_cost_by_user(by_user), "usd") == pytest.approx(total(by_user, "usd"))
    assert total(by_user, "usd") < whole
    b = bill(tables)
    assert total(cost.w_daily_cost(b), "usd") == pytest.approx(total(b, "usd"))
    assert total(cost.w_monthly_bill(b), "usd") == pytest.approx(total(cost.w_cost_by_type(b), "usd"))


def test_real_total_needs_the_export_to_reach_back(frame):
    daily = frame([("2024-01-02", 10.0), ("2024-01-04", 10.0)], "day string, usd double")
    export = frame([("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", 4.0), ("2024-01-09", 8.0)], "d string, dollars double").select(
        F.to_date("d").alias("usage_date"), "dollars"
    )
    real = cost.l_real_billed_total(export, daily)
    assert rows(real) == [(6.0, "2024-01-09")]
    assert rows(cost.l_discount(real, daily)) == [(0.3, 70.0)]
    late = export.filter("usage_date > '2024-01-02'")
    assert rows(cost.l_real_billed_total(late, daily)) == [(None, "2024-01-09")]
    assert rows(cost.l_discount(cost.l_real_billed_total(late, daily), daily)) == [(None, None)]


def test_wasted_cost_guards(frame):
    stats = frame([("a", 10, 1000, 2, 500), ("b", 1, 0, 1, 0), ("no_credits", 5, 100, 5, 100), (None, 1, 10, 1, 10)],
                  "warehouse_name string, total_queries bigint, total_exec_ms bigint, failed_count bigint, failed_exec_ms bigint")
    credits = frame([("a", 4.0), ("b", 9.0)], "warehouse_name string, total_credits double")
    assert rows(cost.wasted_compute_cost(stats, credits, 3.0)) == [(6.0,)]


def test_cost_basis_order(frame):
    credits, storage = frame([(10.0,)], "total_credits double"), frame([(1024.0,)], "total_active_gb double")
    billed = frame([("compute", 5.0), ("adj", -1.0)], "usage_type string, usd double")
    assert rows(cost.w_cost_basis(billed, credits, storage, 2.0, 3.0)) == [(False, 4.0)]
    assert rows(cost.w_cost_basis(None, credits, storage, 2.0, 3.0)) == [(True, 23.0)]
    assert rows(cost.w_cost_basis(None, credits, storage, None, 3.0)) == [(True, 3.0)]
    assert rows(cost.w_estimated_cost(credits, storage, 0.0, 3.0)) == [("storage (estimated)", 3.0)]
    assert cost.w_cost_basis(None, credits, storage) is None


# ---- access ------------------------------------------------------------------


def _history(spark):
    return spark.sql(
        """SELECT query_id, user_name, TIMESTAMP'2024-01-15' AS query_start_time, base_objects_accessed, objects_modified FROM VALUES
        ('q1', 'u@corp.example', array(named_struct('objectName','A','objectDomain','Table'), named_struct('objectName','V','objectDomain','View')),
                                 array(named_struct('objectName','A','objectDomain','Table'))),
        ('q2', 'v@corp.example', array(named_struct('objectName','a','objectDomain','Table'), named_struct('objectName','B','objectDomain','Table')), NULL),
        ('q3', 'svc', NULL, NULL),
        ('q4', 'svc', array(named_struct('objectName','A','objectDomain','Table'), named_struct('objectName','A','objectDomain','Table')), array())
        AS t(query_id, user_name, base_objects_accessed, objects_modified)"""
    )


def _storage(frame):
    return frame([("A", 30, False), ("B", 20, False), ("C", 10, False), ("D", 99, True), ("E", None, False)],
                 "table_name string, active_bytes bigint, deleted boolean").select(
        F.lit("").alias("table_catalog"), F.lit("").alias("table_schema"), "table_name", "active_bytes", "deleted"
    )


def test_access_grains(spark):
    events = access.access_events(_history(spark), WINDOW)
    assert events.count() == 7
    assert rows(access.w_table_access_counts(events)) == [("A", 2), ("B", 1), ("a", 1)]
    assert rows(access.w_user_action_counts(events)) == [
        ("svc", "READ", 1), ("u@corp.example", "READ", 1), ("u@corp.example", "WRITE", 1), ("v@corp.example", "READ", 1),
    ]
    types = spark.sql("SELECT 'svc' AS user_name, 'SERVICE' AS user_type")
    assert rows(access.w_user_table_counts(events, types, DOMAIN)) == [("svc", "A", 1)]


def test_names_match_whatever_their_case(spark, frame):
    events = access.access_events(_history(spark), WINDOW)
    tables = _storage(frame).withColumns({"table_catalog": F.lit("x"), "table_schema": F.lit("s")})
    named = events.withColumn("object_name", F.concat(F.lit("X.s."), "object_name"))
    gb = 1024.0**3
    assert rows(access.dead_tables(tables, named)) == [("x.s.C", 10 / gb), ("x.s.E", 0.0)]
    sizes = rows(access.size_vs_access(tables, named, limit=2))
    assert sizes == [("x.s.A", 30 / gb, 3), ("x.s.B", 20 / gb, 1)]
    detail = rows(access.w_table_access_detail(tables, named, DOMAIN, "E"))
    assert detail == [("X.s.A", 30 / gb, "E", 2, 1), ("X.s.A", 30 / gb, "svc", 1, 0), ("X.s.B", 20 / gb, "E", 1, 0)]


def test_access_identities(tables):
    events = access.access_events(tables["w_access_history"], LI)
    by_table = {}
    for _, user, action, n in access.w_table_rw_by_user(events).collect():
        by_table[user, action] = by_table.get((user, action), 0) + n
    for user, action, n in access.w_user_action_counts(events).collect():
        assert n <= by_table[user, action]
    accessed = {r[0].upper() for r in access.w_table_access_counts(events).collect()}
    dead = {r[0].upper() for r in access.dead_tables(tables["w_table_storage"], events, limit=10_000).collect()}
    assert dead and not dead & accessed


def test_lineage_rollup_gives_the_same_as_the_log(tables):
    log, names = tables["l_lineage"], principal_names(tables["l_principals"])
    rollup = access.l_lineage_rollup(log, LI)
    for measure in (access.l_top_read_tables, access.l_top_write_tables, access.l_user_table_reads, access.l_user_table_writes):
        assert rows(measure(rollup)) == rows(measure(log, LI))
    assert rows(access.l_service_account_tables(rollup, names, DOMAIN, EMPLOYEES)) == rows(
        access.l_service_account_tables(log, names, DOMAIN, EMPLOYEES, LI)
    )


# ---- activity and users ------------------------------------------------------


def test_query_cube_folds_to_every_measure(tables):
    log, types = tables["w_query_history"], user_types(tables["w_users"])
    cube = activity.w_query_cube(log, EV)
    assert rows(activity.fold_cube(cube, "warehouse_name")) == rows(activity.w_warehouse_rollup(log, EV))
    assert rows(users.service_account_stats_of(cube, types, DOMAIN)) == rows(users.w_service_account_stats(log, types, EV, DOMAIN))
    by_user = cube.groupBy("day", "user_name").agg(F.sum("query_count").alias("query_count"))
    assert rows(activity.daily_stats(by_user, "user_name")) == rows(activity.w_daily_query_stats(log, EV))
    assert rows(users.top_users_of(by_user, DOMAIN, EMPLOYEES)) == rows(users.w_top_users(log, EV, DOMAIN, EMPLOYEES))


def test_activity_identities(tables):
    log = tables["w_query_history"]
    in_window = log.filter(EV.ts("start_time")).count()
    assert total(activity.w_daily_query_stats(log, EV), "query_count") == in_window
    db = activity.w_database_activity(log, EV)
    assert total(activity.w_database_activity_trend(db), "query_count") == total(db, "query_count")
    by_user = activity.w_daily_query_by_user(log, EV)
    typed = users.w_daily_volume_by_type(by_user, user_types(tables["w_users"]), DOMAIN)
    assert total(typed, "query_count") == in_window


def test_repeated_dimension_keys_do_not_multiply_rows(frame):
    dim = frame([("k", "a"), ("k", "b"), (None, "z")], "id string, name string")
    got = rows(attach(frame([("k", 1), ("x", 2)], "key string, n int"), "key", dim, "id", "name", "label"))
    assert got == [("k", 1, "b"), ("x", 2, None)]


def test_null_status_is_not_failed(spark):
    log = spark.sql(
        "SELECT TIMESTAMP'2024-01-15' AS start_time, 'w' AS warehouse_name, s AS execution_status, 10L AS execution_time, 0L AS "
        "bytes_spilled_to_local_storage, 0L AS bytes_spilled_to_remote_storage, 0L AS queued_provisioning_time, 0L AS queued_overload_time "
        "FROM VALUES ('SUCCESS'), ('FAILED'), ('INCIDENT'), (NULL) AS t(s)"
    )
    rollup = activity.w_warehouse_rollup(log, WINDOW)
    assert rows(activity.w_exec_stats(rollup)) == [("w", 4, 40, 2, 20)]
    assert activity.w_resource_signals(rollup).count() == 0
    assert rows(activity.failure_rate(activity.w_exec_stats(rollup).filter("total_queries < 0"))) == [(0, 0, 0.0, 0.0)]


def test_average_divides_by_days_with_that_class(frame):
    daily = frame([("d1", "PERSON", 4), ("d2", "PERSON", 2), ("d1", "SERVICE", 7), ("d1", "BOT", 1)], "day string, user_type string, n bigint")
    avg = lambda cond: users.avg_daily_active(daily, cond, "n", "a").collect()[0][0]
    assert (avg(F.col("user_type") == "PERSON"), avg(F.col("user_type") != "PERSON"), avg(F.col("user_type") == "X")) == (3.0, 8.0, 0.0)


def test_task_type_is_that_of_the_first_run(spark):
    log = spark.sql(
        "SELECT 't' AS task_name, TIMESTAMP'2024-01-15' + make_dt_interval(0, h) AS scheduled_time, q AS query_text, s AS state "
        "FROM VALUES (2, 'CALL x', 'SUCCEEDED'), (1, 'merge x', 'FAILED'), (1, 'insert x', NULL), (3, 'CALL x', 'SKIPPED') AS t(h, q, s)"
    )
    assert rows(automation.w_task_runs(automation.w_task_rollup(log, WINDOW))) == [("t", "INSERT", 4, 1, 1)]


# ---- logins ------------------------------------------------------------------


def test_first_policy_wins_against_brute_force(spark, frame):
    rng = random.Random(7)
    cidrs = [f"{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.choice([0, 8, 13, 16, 22, 30, 32])}"
             for _ in range(40)]
    cidrs = [c for c in cidrs if not c.endswith("/0")] + ["1.2.3.4", "broken/8", "1.1.1.1/40"]
    policies = [(f"c{i}", c, i) for i, c in enumerate(cidrs)]
    ips = [f"{rng.randrange(5)}.{rng.randrange(5)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)] + ["1.2.3.4", "", "x", None, "1.2.3.400"]

    def number(ip):
        parts = (ip or "").split(".")
        if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
            return None
        return sum(int(p) << (24 - 8 * i) for i, p in enumerate(parts))

    def expected(ip):
        if not ip:
            return "Unknown"
        for channel, cidr, _ in policies:
            base, n = number(cidr.split("/")[0]), int(cidr.split("/")[1]) if "/" in cidr else 32
            if number(ip) is not None and base is not None and n <= 32 and number(ip) >> (32 - n) == base >> (32 - n):
                return channel
        return "Unmatched"

    by_ip = frame([(ip, 1) for ip in dict.fromkeys(ips)], "client_ip string, login_count bigint")
    got = {r.client_ip: r.channel for r in logins.login_channel(by_ip, frame(policies, "channel string, cidr string, priority int")).collect()}
    assert got == {ip: expected(ip) for ip in ips}
    assert len(set(got.values())) > 5


# ---- skew --------------------------------------------------------------------


def test_a_third_of_the_rows_on_one_key(spark):
    """One user, table, SKU and address holds a third of everything; results against brute force."""
    n = 3000
    base = spark.range(n).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id % 50) END AS who", "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('T', id % 40) END AS tab"
    )
    pairs = [(r.who, r.tab, str(r.id % 700)) for r in base.collect()]
    history = base.selectExpr(
        "CAST(id % 700 AS STRING) AS query_id", "who AS user_name", "TIMESTAMP'2024-01-15' AS query_start_time",
        "array(named_struct('objectName', tab, 'objectDomain', 'Table')) AS base_objects_accessed",
        "CAST(NULL AS array<struct<objectName:string,objectDomain:string>>) AS objects_modified",
    )
    events = access.access_events(history, WINDOW)
    by_table, by_user = defaultdict(set), defaultdict(set)
    for who, tab, q in pairs:
        by_table[tab].add(q)
        by_user[who, "READ"].add(q)
    assert rows(access.w_table_access_counts(events)) == sorted((k, len(v)) for k, v in by_table.items())
    assert rows(access.w_user_action_counts(events)) == sorted((*k, len(v)) for k, v in by_user.items())


def test_channel_is_of_a_range_that_holds_the_address(frame):
    import ipaddress
    import random

    from meterlens.operators.logins import login_channel

    rng = random.Random(4)
    nets = [(f"10.{rng.randrange(3)}.{rng.randrange(4)}.0/{rng.choice([16, 22, 24])}", rng.randrange(3), rng.choice("abcd")) for _ in range(14)]
    policies = [(str(ipaddress.ip_network(n, strict=False)), p, c) for n, p, c in nets]
    addresses = [f"10.{rng.randrange(3)}.{rng.randrange(5)}.{rng.randrange(256)}" for _ in range(60)]
    got = login_channel(frame([(a, 1) for a in set(addresses)], "client_ip string, login_count long"), frame(policies, "cidr string, priority int, channel string"))
    for row in got.collect():
        held = [(p, c) for n, p, c in policies if ipaddress.ip_address(row.client_ip) in ipaddress.ip_network(n)]
        assert row.channel == (min(held)[1] if held else "Unmatched")


def test_pivot_total_is_that_of_its_months(frame):
    from meterlens.operators.ranking import monthly_bill_pivot

    df = frame([("2024-01", "a", 1.0), ("2024-02", "a", 2.0), ("2024-06", "a", 100.0)], "month string, item string, usd double")
    for row in monthly_bill_pivot(df, ["2024-01", "2024-02"], "item").collect():
        assert row.total == row["2024-01"] + row["2024-02"] == 3.0


# ---- prices by day, ranges of policies, sketches ---------------------------------


def _brute_prices(usage, prices, window):
    out = []
    for day, at, sku, quantity in usage:
        first, last = window.day_span()
        if day is not None and first <= day <= last:
            for s, a, b, price in prices:
                if s == sku and at is not None and a is not None and a <= at and (b is None or at < b):
                    out.append((str(day), sku, quantity * price))
    return sorted(out)


def test_prices_by_day_against_brute_force(spark, frame, tmp_path):
    """A SKU with nine tenths of the usage, open, touching, overlapping and empty intervals, usage outside its day."""
    from datetime import datetime, timedelta

    window = Lookback("2024-02-01", 20)
    rng = random.Random(9)
    at = lambda lo, hi: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(lo, hi))
    usage, prices = [], []
    for _ in range(400):
        t = at(-300, 1100)
        usage.append(((t + timedelta(days=rng.choice([0, 0, 0, 1, -1]))).date(), rng.choice([t, t.replace(hour=0)]), "hot" if rng.random() < 0.9 else rng.choice("abc"), 1.0))
    usage += [(datetime(2024, 1, 15).date(), None, "hot", 1.0), (None, at(0, 9), "hot", 1.0)]
    for sku in ("hot", "a", "b"):
        for _ in range(8):
            a = at(-2000, 1200)
            prices.append((sku, a, rng.choice([None, a, a + timedelta(hours=rng.randrange(1, 900)), a + timedelta(days=3), a - timedelta(days=1)]), float(rng.randrange(1, 99))))
    prices += [("hot", None, None, 7.0), ("hot", datetime(2023, 1, 1), None, 5.0), ("hot", datetime(2024, 1, 14, 5), datetime(2024, 1, 20), 3.0)]
    u = frame(usage, "usage_date date, usage_start_time timestamp, sku_name string, usage_quantity double").withColumns(
        {"billing_origin_product": F.lit("p"), "identity_metadata": F.struct(F.lit("w").alias("run_as"))}
    )
    p = frame(prices, "sku_name string, price_start_time timestamp, price_end_time timestamp, d double").withColumn("pricing", F.struct(F.col("d").alias("default")))
    p.write.parquet(str(tmp_path / "prices"))  # whose size is known
    p = spark.read.parquet(str(tmp_path / "prices"))
    expected = _brute_prices(usage, prices, window)
    assert len(expected) > 100 and {e[1] for e in expected} >= {"hot", "a"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, by_day in (("-1", True), ("100g", False)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = cost.priced_usage(u, p, window)
            assert rows(got.select(F.col("usage_date").cast("string"), "sku_name", "usd")) == expected
            assert ("_day" in got._jdf.queryExecution().optimizedPlan().toString()) == by_day
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_sku_is_dealt_out_by_day(spark):
    """With broadcasts off no task gets more than a few days of it."""
    u = spark.range(9000).selectExpr(
        "timestampadd(DAY, CAST(id % 300 AS INT), TIMESTAMP'2023-03-01') AS usage_start_time", "CASE WHEN id % 10 = 0 THEN concat('s', id % 7) ELSE 'hot' END AS sku_name",
        "'p' AS billing_origin_product", "named_struct('run_as', 'w') AS identity_metadata", "1.0D AS usage_quantity",
    ).withColumn("usage_date", F.to_date("usage_start_time"))
    p = spark.sql("SELECT 'hot' AS sku_name, TIMESTAMP'2020-01-01' AS price_start_time, CAST(NULL AS TIMESTAMP) AS price_end_time, named_struct('default', 2.0D) AS pricing")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        per_task = [r["count"] for r in cost.priced_usage(u, p, Lookback("2024-01-01", 365)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 8100 and max(per_task) < 8100 / 4


def test_ranges_of_policies_are_disjoint_and_complete(frame):
    import ipaddress

    rng = random.Random(12)
    for round_ in range(3):
        nets = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.choice([8, 14, 16, 22, 24, 30, 32])}" for _ in range(25)]
        nets += ["0.0.0.0/0"] if round_ == 1 else ["255.255.255.255", "0.0.0.0/32", "broken", "1.2.3.4/40"]
        policies = [(rng.choice("abc"), n, rng.randrange(4)) for n in nets] + [(None, "10.1.0.0/30", 9)]
        parsed = [(p, c or "", ipaddress.ip_network(n, strict=False), c) for c, n, p in policies if "/40" not in n and n != "broken"]
        ranges = rows(logins.channel_ranges(frame(policies, "channel string, cidr string, priority int")))
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and all(low <= high for low, high, _ in ranges)
        assert not any(a[1] + 1 == b[0] and a[2] == b[2] for a, b in zip(ranges, ranges[1:])), "neighbours of one channel are one range"
        points = {int(n.network_address) + d for *_, n, _ in parsed for d in (-1, 0, 1)} | {int(n.broadcast_address) + d for *_, n, _ in parsed for d in (-1, 0, 1)}
        points |= {rng.randrange(10 << 24, 11 << 24) for _ in range(200)}
        addresses = {x: str(ipaddress.ip_address(x)) for x in points if 0 <= x < 1 << 32}
        got = logins.login_channel(frame([(a, 2) for a in addresses.values()], "client_ip string, login_count long"), frame(policies, "channel string, cidr string, priority int"))
        found = {r.client_ip: r.channel for r in got.collect()}
        for x, text in addresses.items():
            held = [(p, order, c) for p, order, n, c in parsed if ipaddress.ip_address(text) in n]
            channel = min(held)[2] if held else None
            assert found[text] == (channel or "Unmatched"), text
            inside = [c for low, high, c in ranges if low <= x <= high]
            assert inside == ([channel] if held else [])


def test_channels_without_policies_or_logins(frame):
    none, ddl = frame([], "channel string, cidr string, priority int"), "client_ip string, login_count long"
    got = {r.client_ip: (r.channel, r.login_count) for r in logins.login_channel(frame([("1.2.3.4", 1), ("", 2), (None, 3), ("x", 4)], ddl), none).collect()}
    assert got == {"1.2.3.4": ("Unmatched", 1), "": ("Unknown", 2), None: ("Unknown", 3), "x": ("Unmatched", 4)}
    assert logins.login_channel(frame([], ddl), frame([("a", "0.0.0.0/0", 1)], "channel string, cidr string, priority int")).count() == 0


def test_sketched_quartiles_are_within_their_rank_error(spark):
    """Per day and merged to months, over 200,000 skewed durations; exact where a day has few rows."""
    from meterlens.operators import activity

    log = spark.range(0, 200_000, 1, 8).selectExpr(
        "timestampadd(DAY, CAST(id % 40 AS INT), TIMESTAMP'2024-01-01') AS start_time", "CAST(pow(id * 7919 % 99991, 1.7) AS BIGINT) + 1 AS execution_time"
    ).union(spark.range(1, 12).selectExpr("TIMESTAMP'2024-03-01' AS start_time", "id AS execution_time"))
    window = Lookback("2024-03-02", 90)
    sketches = activity.w_duration_sketches(log, window)
    days = {r.day: r for r in activity.durations_of(sketches, seconds=False).collect()}
    months = {r.month: r for r in activity.durations_by_month(sketches, seconds=False).collect()}
    assert len(days) == 41 and set(months) == {"2024-01", "2024-02", "2024-03"}
    values = {}
    for r in log.selectExpr("date_format(start_time, 'yyyy-MM-dd') AS day", "execution_time AS v").collect():
        for key in (r.day, r.day[:7]):
            values.setdefault(key, []).append(r.v)
    for key, row in (days | months).items():
        exact = sorted(values[key])
        assert (row.min_ms, row.max_ms) == (exact[0], exact[-1])
        for q, value in zip((0.25, 0.5, 0.75), (row.q1_ms, row.median_ms, row.q3_ms), strict=True):
            low, high = (sum(v < value for v in exact) / len(exact), sum(v <= value for v in exact) / len(exact))
            assert low - 2 * activity.RANK_ERROR <= q <= high + 2 * activity.RANK_ERROR
    assert (days["2024-03-01"].q1_ms, days["2024-03-01"].median_ms, days["2024-03-01"].q3_ms) == (3, 6, 9)
    plain = {r.day: tuple(r) for r in activity.w_daily_duration(log, Lookback("2024-03-02", 1)).collect()}
    assert plain == {r.day: tuple(r) for r in activity.durations_of(activity.w_duration_sketches(log, Lookback("2024-03-02", 1)), seconds=True).collect()}


def test_storage_of_more_bytes_than_a_long_holds(frame):
    huge = 2**62
    rows = [(huge, 1, None, huge, False)] * 3 + [(huge, 1, None, 5, True)]
    ddl = "active_bytes long, time_travel_bytes long, failsafe_bytes long, retained_for_clone_bytes long, deleted boolean"
    found = storage.w_storage_summary(frame(rows, ddl)).collect()[0]
    assert tuple(found) == (3 * 2.0**32, 3 / 2.0**30, 0.0, 3 * 2.0**32)
    assert [tuple(r) for r in storage.w_storage_summary(frame([], ddl)).collect()] == [(0.0, 0.0, 0.0, 0.0)]
