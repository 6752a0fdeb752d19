"""newsloom: a Spark engine that curates, enriches, merges and publishes article collections.

Every operator takes and returns DataFrames. See README.md for the operator map.
"""
