"""Composed reports, and the registered queries with their SQL counterparts."""
