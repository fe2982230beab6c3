"""Operators over drawing relations: shapes, filters, joins and aggregates."""
