"""Functions of the lineage engine."""
