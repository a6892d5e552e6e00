"""Registered queries: each operator over the given tables, with its SQL twin where SQL can express it."""
