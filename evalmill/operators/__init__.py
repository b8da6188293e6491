"""Operators on DataFrames: curation, sampling, joins, metrics, statistics, decisions, kernels and models."""
