"""Relational operators behind an immutable frame."""

from .frame import Frame, Grouped

__all__ = ["Frame", "Grouped"]
