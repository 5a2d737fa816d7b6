"""Maintenance of fact tables by edits."""
