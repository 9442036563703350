"""All registered queries."""

from tapeworks.plans import accounting, market, models, streams  # noqa: F401
from tapeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
