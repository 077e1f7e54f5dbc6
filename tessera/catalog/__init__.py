"""All queries by name, and the SQL that each is held against."""

from tessera.catalog import aggregates, braces, extraction, graph, memory, modules, resolution, runs, search, security, storage, streams  # noqa: F401  each registers its queries
from tessera.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
