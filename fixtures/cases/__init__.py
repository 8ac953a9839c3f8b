"""All registered queries, by area."""

from fixtures.cases import access, activity, compare, cost, inventory, scalars, sources, users  # noqa: F401
from fixtures.cases.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
