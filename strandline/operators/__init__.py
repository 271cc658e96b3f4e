"""Operators of the lineage engine."""
