"""Streaming of the lineage engine."""
