"""Every query of the engine by name, with the SQL that its result equals."""

from __future__ import annotations

from . import calendars, choosing, covered, estimation, experiments, forecasts, further, journeys, relational, series  # noqa: F401  registers their queries
from .registry import QUERIES, SQL

FLAGSHIP = "mea_variant_stats_3way"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
