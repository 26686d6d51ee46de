"""Every operator as a named query over the driver's tables, with the SQL it must agree with."""

from clickspan.catalogue import (  # noqa: F401
    alerts, counts, funnels, growth, ingest, marketing, rollups, sessions, users,
)
from clickspan.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
