"""Leakage-aware train/test benchmarks from labelled sequence collections, as Spark DataFrames."""
