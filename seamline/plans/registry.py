"""All queries over the given tables, with their SQL."""

from __future__ import annotations

from seamline.plans import colour_queries, file_queries, job_queries, long_queries, path_queries, raster_queries, region_queries, stitch_queries  # noqa: F401
from seamline.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
