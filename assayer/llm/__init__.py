"""Operators for large training corpora: deduplication, filtering, extraction, search and tokenisation."""
