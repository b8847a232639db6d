"""Queries that apply the operators to the given tables, each with its SQL twin where SQL can express it."""
