"""Registered queries, one module per family, each beside its SQL."""
