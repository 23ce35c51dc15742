"""Corpus-scale HTML analytics on Spark."""
