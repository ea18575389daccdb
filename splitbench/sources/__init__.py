"""Readers for sequence files, metadata and similarity tables, and adapters from other tables."""
