"""Registered queries over the driver's tables."""

from plotline.plans import composites, disclosures, models, records, relational, reports, rows, series  # noqa: F401
from plotline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
