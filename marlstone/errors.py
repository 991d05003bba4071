"""Errors that a statement can end in; their texts are part of the API."""


class EngineError(Exception):
    """A statement failed; nothing was changed."""


class ParseError(EngineError):
    """The statement can't be read."""

    def __init__(self, what: str):
        super().__init__(f"parse error: {what}")
