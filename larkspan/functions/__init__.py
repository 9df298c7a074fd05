"""Expressions: `Col`, `Lit` and the functions of `F`, checked against a schema before Spark sees them."""

from .expressions import Col, Expression, F, Lit, floor_mod

__all__ = ["Col", "Expression", "F", "Lit", "floor_mod"]
