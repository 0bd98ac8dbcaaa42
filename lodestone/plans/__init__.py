"""Registered queries over the provided tables, and the SQL they must agree with."""
