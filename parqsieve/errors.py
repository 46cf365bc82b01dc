"""What can be wrong with a predicate."""

from __future__ import annotations


class PredicateError(ValueError):
    """Base of the kinds below."""


class UnsupportedExpression(PredicateError):
    def __init__(self, kind: str):
        self.kind = kind
        super().__init__(f"no metadata can decide this kind of expression: {kind}")


class ColumnExpected(PredicateError):
    def __init__(self, found: str):
        self.found = found
        super().__init__(f"a column belongs here, not {found}")


class LiteralExpected(PredicateError):
    def __init__(self, found: str):
        self.found = found
        super().__init__(f"a literal belongs here, not {found}")


class ColumnNotFound(PredicateError):
    def __init__(self, column: str):
        self.column = column
        super().__init__(f"the schema has no column {column!r}")


class AmbiguousColumn(PredicateError):
    def __init__(self, column: str, candidates: list[str]):
        self.column, self.candidates = column, candidates
        super().__init__(f"column {column!r} may be any of: {', '.join(candidates)}")


class CastFailed(PredicateError):
    def __init__(self, value: object, target: str, reason: str):
        self.value, self.target, self.reason = value, target, reason
        super().__init__(f"{value!r} is no {target}: {reason}")


class NegationUnsupported(PredicateError):
    def __init__(self, kind: str):
        self.kind = kind
        super().__init__(f"NOT {kind} isn't supported in strict mode")


class OperatorUnsupported(PredicateError):
    def __init__(self, operator: str):
        self.operator = operator
        super().__init__(f"operator {operator!r} isn't supported on metadata")
