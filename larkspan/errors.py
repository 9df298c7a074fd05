"""Errors that building a query can raise, before anything runs."""


class ParseError(ValueError):
    """The text isn't a query."""


class SemanticError(ValueError):
    """The text is a query, but of something that doesn't exist, as a function."""


class GroupByError(SemanticError):
    """A selected column is neither grouped by nor aggregated."""
