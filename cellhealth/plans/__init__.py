"""Registered queries: the operators wired to the given tables, and the SQL they are checked with."""
