"""Adapters of the given tables, and the registered queries."""
