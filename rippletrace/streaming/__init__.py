"""Incremental analysis of arriving diffs."""
