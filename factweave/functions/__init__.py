"""Column expressions: names and keys, integer intervals, type sets, value functions."""
