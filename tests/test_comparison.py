"""Projection and comparison on hand-made summaries."""

import pytest
from pyspark.sql import functions as F

from meterlens.plans import comparison as c
from meterlens.schemas import schema

BASE = {
    "platform": "p", "lookback_days": 90, "generated_at": "now", "total_cost_usd": 100.0, "cost_is_estimate": False,
    "compute_cost_usd": 50.0, "compute_cost_is_estimate": False, "real_billed_discount_ratio": None, "total_compute_seconds": 200.0,
    "total_queries": 10, "active_users_human": 1.0, "active_users_service": 2.0, "failed_query_count": 1, "total_tables": 3,
    "total_schemas": 2, "total_databases_or_catalogs": 1, "total_storage_gb": None, "automation_run_count": 4,
    "automation_success_rate_percent": 50.0,
}


@pytest.fixture
def summary(spark):
    def build(**changes):
        return spark.createDataFrame([tuple((BASE | changes)[f.name] for f in schema("platform_summary"))], schema("platform_summary"))

    return build


def one(df):
    (row,) = df.collect()
    return tuple(row)


@pytest.mark.parametrize("days,mismatch", [(88, False), (92, False), (93, True), (30, True)])
def test_mismatch_beyond_two_days(summary, days, mismatch):
    w, l, flag, message = one(c.lookback_mismatch(summary(), summary(lookback_days=days)))
    assert (w, l, flag) == (90, days, mismatch)
    assert (message is not None) == mismatch and (not mismatch or str(days) in message)


def test_projection(summary):
    l = summary(compute_cost_usd=30.0, total_compute_seconds=60.0, real_billed_discount_ratio=0.8)
    p = c.migration_projection(summary(), l)
    assert one(p) == (200.0, 50.0, 0.5, 100.0, 80.0, 0.8)
    assert one(c.projection_delta(p)) == (100.0, "more", 60.0, "more")


def test_projection_without_rate_or_cost(summary):
    p = c.migration_projection(summary(compute_cost_usd=0.0), summary(total_compute_seconds=0.0))
    assert one(p) == (200.0, 0.0, 0.0, 0.0, None, None)
    assert one(c.projection_delta(p)) == (None, None, None, None)
    cheaper = c.projection_delta(c.migration_projection(summary(), summary(compute_cost_usd=5.0)))
    assert one(cheaper) == (90.0, "less", None, None)


def test_table(summary):
    plain = c.comparison_table(summary(), summary(cost_is_estimate=True, failed_query_count=0, total_queries=0))
    got = {r.metric: tuple(r)[1:] for r in plain.collect()}
    assert got["total_cost_usd"] == (100.0, 100.0, "real", "estimate")
    assert got["failure_rate_percent"] == (10.0, 0.0, None, None)
    assert got["total_storage_gb"] == (None, None, None, None)
    assert "projected_cost_adjusted_usd" not in got
    adjusted = c.comparison_table(summary(), summary(real_billed_discount_ratio=0.5)).filter(F.col("metric").contains("adjusted"))
    assert one(adjusted) == ("projected_cost_adjusted_usd", None, 25.0, None, "estimate")
