"""Registry of the catalogue queries and their DuckDB SQL."""

from __future__ import annotations

from plumbline.plans import catalog_findings, catalog_fleet, catalog_graph, catalog_more, catalog_packages, catalog_runs, catalog_sources  # noqa: F401  register their queries
from plumbline.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
