"""Registered queries and their oracle SQL."""

from __future__ import annotations

from starloom.queries import catalog, more, reports, sky, streams

QUERIES: dict = {**sky.QUERIES, **catalog.QUERIES, **more.QUERIES, **reports.QUERIES, **streams.QUERIES}
ORACLES: dict = {**sky.ORACLES, **catalog.ORACLES, **more.ORACLES, **reports.ORACLES, **streams.ORACLES}
FLAGSHIP = "discovery_ranking"
