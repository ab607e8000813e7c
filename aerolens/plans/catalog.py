"""All registered queries."""

from . import features, forecasts, incremental, monitoring, profiles, readings, drifts, composed  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
