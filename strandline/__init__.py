"""Strandline: a Spark-native engine for DNA search, in-silico PCR and probe design."""

__version__ = "0.1.0"
