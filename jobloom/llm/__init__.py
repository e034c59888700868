"""Operators for large training corpora: filters, near-copy search, contamination, scoring and mixing."""
