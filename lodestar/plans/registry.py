"""Every registered query with its oracle, gathered from the modules that define them."""

from __future__ import annotations

from lodestar.plans import codes, graphs, routes, searches, updates, vectors  # noqa: F401
from lodestar.plans.catalog import ORACLES, QUERIES, query  # noqa: F401
