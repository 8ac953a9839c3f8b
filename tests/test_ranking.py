"""Ranking, folding, pivot and series shapes."""

import pytest

from meterlens.operators import ranking as r


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def keyed(frame, n):
    return frame([(f"k{i:02d}", 100.0 - i) for i in range(n)], "key string, v double")


@pytest.mark.parametrize("count,expected", [(4, 4), (5, 5), (6, 6), (7, 6), (30, 6)])
def test_other_appears_only_beyond_one_over(frame, count, expected):
    got = dict(rows(r.top_n_with_other(keyed(frame, count), "key", "v", 5)))
    assert len(got) == expected
    assert ("Other" in got) == (count > 6)
    assert sum(got.values()) == pytest.approx(sum(100.0 - i for i in range(count)))


def test_trend_form_always_folds(frame):
    daily = frame([(d, f"k{i}", 10 - i) for d in ("d1", "d2") for i in range(7)], "day string, key string, v int")
    got = rows(r.top_n_trend(daily, "key", "v", 6, ["day"]))
    assert len(got) == 14 and ("d1", "Other", 4) in got


def test_ties_break_by_name_and_null_keys_stay(frame):
    df = frame([("b", 1.0), ("a", 1.0), (None, 1.0), ("c", 1.0), ("d", 0.5)], "key string, v double")
    got = {k: v for k, v in r.top_n_with_other(df, "key", "v", 2, keep_one_over=False).collect()}
    assert got == {None: 1.0, "a": 1.0, "Other": 2.5}
    assert [x.key for x in r.top_k(df, 3, "v", "key").collect()] == [None, "a", "b"]


def test_a_key_named_other_stays_its_own_row(frame):
    df = frame([("Other", 9.0), ("a", 8.0), ("b", 1.0), ("c", 2.0)], "key string, v double")
    assert rows(r.top_n_with_other(df, "key", "v", 2)) == [("Other", 3.0), ("Other", 9.0), ("a", 8.0)]


def test_latest_snapshot_is_per_key(frame):
    df = frame([("a", "2024-01-01", 1.0), ("a", "2024-01-02", 2.0), ("a", "2024-01-02", 3.0), ("old", "2023-01-01", 9.0)], "k string, d string, v double")
    assert rows(r.latest_snapshot(df, "k", "d", "v")) == [("a", "2024-01-02", 5.0), ("old", "2023-01-01", 9.0)]


def test_cumulative_ends_at_the_total(frame):
    df = frame([("2024-01-02", 2.0), ("2024-01-01", 1.5), ("2024-01-03", -1.0)], "day string, usd double")
    assert rows(r.cumulative_cost(df)) == [("2024-01-01", 1.5), ("2024-01-02", 3.5), ("2024-01-03", 2.5)]


def test_bill_grid(frame):
    bill = [("2024-01", f"u{i}", 10.0 - i) for i in range(10)] + [("2024-02", "u0", 1.0), ("2024-02", "Adj x", -5.0)]
    df = frame(bill, "month string, item string, usd double")
    grid = {g[0]: tuple(g)[1:] for g in r.monthly_bill_pivot(df, ["2024-01", "2024-02", "2024-03"], "item").collect()}
    assert len(grid) == 8 + 1 + 1 + 1
    assert grid["u0"] == (False, 11.0, 10.0, 1.0, 0.0)
    assert grid["Other"] == (False, 3.0, 3.0, 0.0, 0.0)
    assert grid["Adj x"] == (True, -5.0, 0.0, -5.0, 0.0)
    assert grid["TOTAL"] == (False, 51.0, 55.0, -4.0, 0.0)


def test_bill_grid_without_adjustments(frame):
    df = frame([("2024-01", "adj", 1.0), ("2024-01", "b", 2.0)], "month string, item string, usd double")
    grid = rows(r.monthly_bill_pivot(df, ["2024-01"], "item", top_n=1, adjustments_apart=False))
    assert grid == [("Other", False, 1.0, 1.0), ("TOTAL", False, 3.0, 3.0), ("b", False, 2.0, 2.0)]


def test_densify(frame):
    df = frame([("d1", "person", 3), ("d2", "service", 4)], "day string, t string, n bigint")
    assert rows(r.densify_daily_series(df, "t", "n")) == [
        ("d1", "person", 3), ("d1", "service", 0), ("d2", "person", 0), ("d2", "service", 4),
    ]


def test_span_falls_back(frame):
    assert tuple(r.data_span(frame([("2024-02-28",), ("2024-03-01",)], "day string"), 90).collect()[0]) == ("2024-02-28", "2024-03-01", 3)
    assert tuple(r.data_span(frame([], "day string"), 90).collect()[0]) == (None, None, 90)


def test_merge_one_row(frame):
    merged = r.merge_one_row(frame([(1, True)], "a int, b boolean"), frame([("x",)], "c string"), frame([(None,)], "d double"))
    assert [tuple(x) for x in merged.collect()] == [(1, True, "x", None)]
