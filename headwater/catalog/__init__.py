"""Named queries over the driver tables, each with the SQL that checks it."""

from headwater.catalog import analytics, documents, exchange, integrity, publishing, rasters, releases
from headwater.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "documents", "exchange", "integrity", "publishing", "rasters", "releases"]
