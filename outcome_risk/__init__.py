"""Outcome-risk analytics on Spark: one row per entity, one yes/no outcome."""

from outcome_risk.roles import Roles, column_families, match_columns, resolve_roles

__all__ = ["Roles", "column_families", "match_columns", "resolve_roles"]
