"""Queries over the star-schema tables and their SQL counterparts."""

from __future__ import annotations

from subsidia.plans import documents, features, geography, ingest, layers, report, service, storage, terrain, tiles
from subsidia.plans.catalog import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "documents", "features", "geography", "ingest", "layers", "report", "service", "storage", "terrain", "tiles"]

FLAGSHIP = features.anomaly_buildings
