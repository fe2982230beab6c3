"""Whole queries: extraction, scale detection and cleanup, and the geometry recipe."""
