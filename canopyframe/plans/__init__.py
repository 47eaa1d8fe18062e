"""Queries: operators bound to tables, with SQL equivalents."""
