"""Spark jobs for a two-stage listing recommender."""
