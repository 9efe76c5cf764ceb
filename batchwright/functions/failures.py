"""What kind of failure an exception is."""

from __future__ import annotations

import re

REASONS = ("ValidationError", "ConcurrencyConflict", "DuplicateKey", "DatabaseConstraint", "BusinessKeyConflictLost", "Unknown")
_DUPLICATE = re.compile(r"duplicate key|unique constraint|already exists", re.I)
_CONSTRAINT = re.compile(r"constraint|foreign key|not[ -]null", re.I)
_CONFLICT = re.compile(r"concurren|version conflict|was changed by another", re.I)
_TRANSIENT = re.compile(r"time[d]?[ -]?out|deadlock|lock(ed)?\b|connection (refused|reset|closed|lost)|temporarily|throttl|unavailable", re.I)


def classify(error: Exception) -> str:
    """A reason for an exception of a validator or a sink."""
    text = str(error)
    if isinstance(error, (ValueError, AssertionError)):
        return "ValidationError"
    if _CONFLICT.search(text):
        return "ConcurrencyConflict"
    if _DUPLICATE.search(text):
        return "DuplicateKey"
    return "DatabaseConstraint" if _CONSTRAINT.search(text) else "Unknown"


def is_transient(error: Exception) -> bool:
    """Whether trying again may help."""
    return isinstance(error, (TimeoutError, ConnectionError)) or bool(_TRANSIENT.search(str(error)))
