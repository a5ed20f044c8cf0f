"""Error classes: user errors (bad request) vs everything else."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException


class LayerQueryError(ValueError):
    """The request is invalid (maps to an HTTP 400 in a service shell)."""


# Runtime error classes raised by ANSI evaluation that mean "the user's
# predicate is bad" rather than "the system failed".
_USER_RUNTIME_CONDITIONS = (
    "CAST_INVALID_INPUT",
    "DIVIDE_BY_ZERO",
    "ARITHMETIC_OVERFLOW",
    "INVALID_FORMAT",
    "INVALID_PARAMETER_VALUE",
    "NUMERIC_VALUE_OUT_OF_RANGE",
    "DATETIME_FIELD_OUT_OF_BOUNDS",
    "CANNOT_PARSE_TIMESTAMP",
)


def as_user_error(exc: BaseException) -> BaseException:
    """Map parse / analysis / ANSI runtime errors to ``LayerQueryError``."""
    if isinstance(exc, LayerQueryError):
        return exc
    if isinstance(exc, (ParseException, AnalysisException)):
        return LayerQueryError(f"invalid query: {exc}")
    cond = getattr(exc, "getCondition", None) or getattr(exc, "getErrorClass", None)
    name = None
    try:
        name = cond() if cond else None
    except Exception:  # pragma: no cover - defensive
        name = None
    text = str(exc)
    if name in _USER_RUNTIME_CONDITIONS or any(c in text for c in _USER_RUNTIME_CONDITIONS):
        return LayerQueryError(f"invalid query: {exc}")
    return exc
