"""The registered queries: each key has a Spark query and, where SQL can say it, its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame

from fixtures.views import (
    EVENTS_AS_OF,
    EVENTS_DAYS,
    LINEITEM_AS_OF,
    LINEITEM_DAYS,
    ORDERS_AS_OF,
    ORDERS_DAYS,
    Tables,
    with_views,
)
from meterlens.functions import Lookback

Build = Callable[[Tables], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

EV = Lookback(EVENTS_AS_OF, EVENTS_DAYS)
OR = Lookback(ORDERS_AS_OF, ORDERS_DAYS)
LI = Lookback(LINEITEM_AS_OF, LINEITEM_DAYS)


def _since(as_of: str, days: int) -> str:
    return f"TIMESTAMP '{date.fromisoformat(as_of) - timedelta(days=days)}'"


E_SINCE = _since(EVENTS_AS_OF, EVENTS_DAYS)
O_SINCE = _since(ORDERS_AS_OF, ORDERS_DAYS)
L_SINCE = _since(LINEITEM_AS_OF, LINEITEM_DAYS)
E_UNTIL, O_UNTIL, L_UNTIL = (_since(as_of, 0) for as_of in (EVENTS_AS_OF, ORDERS_AS_OF, LINEITEM_AS_OF))
GB = "1073741824.0"


def case(key: str, build: Build, sql: str, *views: str, ctes: dict[str, str] | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"{key} is registered twice")
    QUERIES[key] = build
    ORACLES[key] = with_views(sql, *views, ctes=ctes)


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def folded(totals: str, key: str, value: str, n: int, keep_one_over: bool = True) -> str:
    """Top n keys of ``totals`` and one Other row."""
    named = f"rn <= {n}" + (f" OR cnt <= {n + 1}" if keep_one_over else "")
    return (
        f"SELECT CASE WHEN {named} THEN {key} ELSE 'Other' END AS {key}, round(sum({value}), 6) AS {value} FROM ("
        f"SELECT *, row_number() OVER (ORDER BY {value} DESC NULLS LAST, {key} NULLS FIRST) AS rn, count(*) OVER () AS cnt "
        f"FROM {totals}) GROUP BY 1"
    )
