"""Registered queries by module: each module has QUERIES and SQL."""
