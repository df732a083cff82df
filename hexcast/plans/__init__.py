"""Registered queries with their SQL oracles."""

from hexcast.plans import areas, forecasts, hexagons, hotspots, panels, queries, serving, storage

__all__ = ["areas", "forecasts", "hexagons", "hotspots", "panels", "queries", "serving", "storage"]
