"""Provenance analytics on Spark: events, windows, scores, graphs, incidents and memory as DataFrames."""
