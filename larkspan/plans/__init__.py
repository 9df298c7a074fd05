"""From query text to frames."""

from .dialect import parse, run

__all__ = ["parse", "run"]
