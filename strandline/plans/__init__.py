"""Plans of the lineage engine."""
