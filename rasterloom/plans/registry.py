"""Queries by name, and the SQL that each is held against."""

from rasterloom.plans import layer_queries, raster_queries  # noqa: F401

QUERIES: dict = dict(raster_queries.QUERIES)
ORACLE_SQL: dict = dict(raster_queries.ORACLE_SQL)
