"""Registered queries and their SQL twins over the given tables."""
