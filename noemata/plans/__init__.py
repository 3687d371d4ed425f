"""Registered queries over the tables, and SQL with the same results."""
