"""Sinks of the lineage engine."""
