"""Cells, neighbourhoods and geometry."""
