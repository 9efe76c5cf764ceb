"""Errors that abort a whole call."""


class BatchError(ValueError):
    """The batch as a whole can't be applied: nothing was attempted."""


class DetailError(RuntimeError):
    """A result was asked for more than its level of detail keeps."""
