"""Operators for preparing large text corpora: quality, deduplication, search, tokens, mixing and archives."""
