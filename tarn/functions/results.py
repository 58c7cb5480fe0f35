"""Outcomes as values: a result or an error, and errors that say where they come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class ContextError(ValueError):
    """An error with what was being done when it came up; ``__cause__`` is the error below it."""

    def __init__(self, reason: str, **context: Any):
        self.reason, self.context = reason, context
        where = ", ".join(f"{k}={v}" for k, v in context.items())
        super().__init__(f"{reason} [{where}]" if where else reason)


def wrap(error: Exception, reason: str, **context: Any) -> ContextError:
    """The error with a reason before it; it stays the cause."""
    out = ContextError(f"{reason}: {error}", **context)
    out.__cause__ = error
    return out


def join(*errors: Exception | None) -> ExceptionGroup | None:
    """Several errors as one, line by line; None if there are none."""
    found = [e for e in errors if e is not None]
    return ExceptionGroup("\n".join(map(str, found)), found) if found else None


@dataclass(frozen=True)
class Result:
    """A value or an error."""

    value: Any = None
    error: Exception | None = None

    @classmethod
    def of(cls, work: Callable[[], Any]) -> Result:
        """The outcome of a call; errors of value and key are outcomes, others are raised."""
        try:
            return cls(work())
        except (ValueError, KeyError) as error:
            return cls(error=error)

    @property
    def ok(self) -> bool:
        return self.error is None

    def map(self, function: Callable[[Any], Any]) -> Result:
        return Result(function(self.value)) if self.ok else self

    def and_then(self, function: Callable[[Any], Result]) -> Result:
        return function(self.value) if self.ok else self

    def or_else(self, function: Callable[[Exception], Result]) -> Result:
        return self if self.ok else function(self.error)

    def inspect(self, function: Callable[[Any], Any]) -> Result:
        if self.ok:
            function(self.value)
        return self

    def value_or(self, other: Any) -> Any:
        return self.value if self.ok else other

    def unwrap(self) -> Any:
        if self.error is not None:
            raise self.error
        return self.value
