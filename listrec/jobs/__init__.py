"""Chained jobs."""
