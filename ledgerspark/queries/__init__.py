"""Queries over the given tables, one for each operator or group of operators."""
