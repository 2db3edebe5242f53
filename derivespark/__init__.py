"""Spark jobs that derive, check and compare analysis datasets, and operators for large text corpora."""
