"""Operators for large text corpora: archives, deduplication, scans, scoring, mixing and sharding."""
