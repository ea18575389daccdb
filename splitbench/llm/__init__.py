"""Operators for preparing large text corpora: formatting, filtering, duplicates, packing and scoring."""
