"""What can go wrong, and the way checks report it."""

from __future__ import annotations

from pyspark.sql import DataFrame

PREVIEW = 5


class SplitbenchError(Exception):
    """Base of all errors that a user can act on."""


class ConfigurationError(SplitbenchError):
    pass


class InputError(SplitbenchError):
    pass


class IntegrityError(SplitbenchError):
    pass


class ExternalToolError(SplitbenchError):
    pass


def require_empty(violations: DataFrame, message: str, error: type[SplitbenchError] = InputError) -> None:
    """Raise error with at most five examples if a violations query has rows."""
    found = [", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in violations.limit(PREVIEW + 1).collect()]
    if found:
        more = "; and more" if len(found) > PREVIEW else ""
        raise error(f"{message}: " + "; ".join(found[:PREVIEW]) + more)
