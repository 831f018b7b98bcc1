"""Errors of the engine."""


class SluiceError(Exception):
    """The base of all."""


class ParseError(SluiceError, ValueError):
    """An answer that can't be used; its text goes back to the model."""


class OutputError(SluiceError, ValueError):
    """A result that the output's format can't hold as it is."""
