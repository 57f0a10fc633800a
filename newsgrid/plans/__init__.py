"""Composite jobs, and the query catalogue built on them."""
