"""Composed plans: capture view over the test tables, query registry, oracles."""
