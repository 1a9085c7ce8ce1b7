"""Versioned, namespaced text records on Spark: an append-only log read as lazy DataFrames."""
