"""Costs, rasters, edges, routes and metrics."""
