"""Operators of the recommender: each takes and returns DataFrames."""
