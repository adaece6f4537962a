"""Errors that statements can end with."""


class EngineError(Exception):
    """Any failure of a statement."""


class ParseError(EngineError):
    """The text is not a statement of the dialect."""


class BindError(EngineError):
    """Names or types don't fit the tables."""


class ConstraintError(EngineError):
    """A row or table is kept from a change by a constraint; nothing has changed."""
