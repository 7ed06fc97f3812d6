"""Registered queries: operators applied to the given tables, each with its SQL."""
