"""Imports every module that registers queries."""

from wiretally.plans import access, landed, limits, patterns, reports, rollups, routing, screening  # noqa: F401
from wiretally.plans.registry import ORACLES, QUERIES  # noqa: F401
