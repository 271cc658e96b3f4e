"""Strandline: a Spark-native engine for data-lineage graphs, scheduler catalogues and training-data corpora."""

__version__ = "0.1.0"
