"""All named queries in one place."""

from __future__ import annotations

from terralag.plans import forecasts, ingest, linear, modelling, stats  # noqa: F401
from terralag.plans.cleaning import flagship
from terralag.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
