"""Importing this module registers every query."""

from quarry.plans import catalog_queries, check_queries, container_queries, link_queries, scalar_queries  # noqa: F401
