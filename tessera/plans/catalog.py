"""Every query by name, and its SQL."""

from __future__ import annotations

from tessera.plans import kernel_queries, raster_queries, scene_queries, store_queries, tiepoint_queries

_PARTS = (tiepoint_queries, raster_queries, store_queries, kernel_queries, scene_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
