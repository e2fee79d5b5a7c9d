"""Whole runs put together from the operators, and the queries over the star-schema tables."""
