"""Sources of the lineage engine."""
