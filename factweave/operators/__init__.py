"""Relational operators over program facts, on any table with the named columns."""
