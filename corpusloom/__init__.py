"""Corpus preparation on Spark: every step takes and returns DataFrames."""
