"""Compound operators: split protocols, the benchmark run and its validator."""
