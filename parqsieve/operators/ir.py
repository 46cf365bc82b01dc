"""The predicate form: frozen dataclasses with builders, text and JSON."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
from dataclasses import dataclass, fields
from enum import Enum
from typing import Any


class Op(Enum):
    EQ, NE, LT, LE, GT, GE = "=", "!=", "<", "<=", ">", ">="

    def flip(self) -> Op:
        """The operator when the sides change places."""
        return {Op.LT: Op.GT, Op.LE: Op.GE, Op.GT: Op.LT, Op.GE: Op.LE}.get(self, self)


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def parts(self) -> tuple[Predicate, ...]:
        return ()

    def columns(self) -> list[str]:
        """The columns it names, sorted, each once."""
        own = {self.column} if hasattr(self, "column") else set()
        return sorted(own.union(*(p.columns() for p in self.parts())))

    def to_json(self) -> str:
        return json.dumps(_plain(self))


@dataclass(frozen=True)
class Const(Predicate):
    value: bool

    def __str__(self) -> str:
        return str(self.value).upper()


@dataclass(frozen=True)
class Cmp(Predicate):
    column: str
    op: Op
    value: Any

    def __str__(self) -> str:
        return f"{self.column} {self.op.value} {self.value!r}"


@dataclass(frozen=True)
class Between(Predicate):
    column: str
    low: Any
    high: Any
    inclusive: bool = True

    def sides(self) -> tuple[Cmp, Cmp]:
        return (Cmp(self.column, Op.GE if self.inclusive else Op.GT, self.low), Cmp(self.column, Op.LE if self.inclusive else Op.LT, self.high))

    def __str__(self) -> str:
        return f"{self.column} BETWEEN {self.low!r} AND {self.high!r}" if self.inclusive else " AND ".join(map(str, self.sides()))


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: tuple[Any, ...]

    def __str__(self) -> str:
        return f"{self.column} IN ({', '.join(map(repr, self.values))})"


@dataclass(frozen=True)
class Prefix(Predicate):
    column: str
    prefix: str

    def __str__(self) -> str:
        return f"{self.column} LIKE '{self.prefix}%'"


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str
    negated: bool = False

    def __str__(self) -> str:
        return f"{self.column} IS {'NOT ' * self.negated}NULL"


class _Many(Predicate):
    word, empty = "", ""

    def parts(self) -> tuple[Predicate, ...]:
        return self.terms

    def __str__(self) -> str:
        if len(self.terms) < 2:
            return str(self.terms[0]) if self.terms else self.empty
        return "(" + f" {self.word} ".join(map(str, self.terms)) + ")"


@dataclass(frozen=True)
class And(_Many):
    terms: tuple[Predicate, ...]
    word, empty = "AND", "TRUE"
    __str__ = _Many.__str__


@dataclass(frozen=True)
class Or(_Many):
    terms: tuple[Predicate, ...]
    word, empty = "OR", "FALSE"
    __str__ = _Many.__str__


@dataclass(frozen=True)
class Not(Predicate):
    term: Predicate

    def parts(self) -> tuple[Predicate, ...]:
        return (self.term,)

    def __str__(self) -> str:
        return f"NOT ({self.term})"


@dataclass(frozen=True)
class Hint(Predicate):
    """Evidence on = or IN beside statistics: "bloom" or "dictionary". Put in by the pruner, never by users."""

    kind: str
    column: str
    values: tuple[Any, ...]

    def __str__(self) -> str:
        return f"<{'bloom filter' if self.kind == 'bloom' else 'dictionary hint'}>"


TRUE, FALSE = Const(True), Const(False)


def cmp(column: str, op: Op | str, value: Any) -> Cmp:
    return Cmp(column, Op(op), value)


def eq(column: str, value: Any) -> Cmp:
    return Cmp(column, Op.EQ, value)


def ne(column: str, value: Any) -> Cmp:
    return Cmp(column, Op.NE, value)


def lt(column: str, value: Any) -> Cmp:
    return Cmp(column, Op.LT, value)


def le(column: str, value: Any) -> Cmp:
    return Cmp(column, Op.LE, value)


def gt(column: str, value: Any) -> Cmp:
    return Cmp(column, Op.GT, value)


def ge(column: str, value: Any) -> Cmp:
    return Cmp(column, Op.GE, value)


def between(column: str, low: Any, high: Any, inclusive: bool = True) -> Between:
    return Between(column, low, high, inclusive)


def in_list(column: str, values: list | tuple) -> In:
    return In(column, tuple(values))


def starts_with(column: str, prefix: str) -> Prefix:
    return Prefix(column, prefix)


def is_null(column: str) -> IsNull:
    return IsNull(column)


def is_not_null(column: str) -> IsNull:
    return IsNull(column, True)


def all_of(*terms: Predicate) -> And:
    return And(tuple(terms))


def any_of(*terms: Predicate) -> Or:
    return Or(tuple(terms))


def negate(term: Predicate) -> Not:
    return Not(term)


_CLASSES = {c.__name__: c for c in (Const, Cmp, Between, In, Prefix, IsNull, And, Or, Not, Hint)}


def _plain(x: Any) -> Any:
    if isinstance(x, Predicate):
        return {"is": type(x).__name__} | {f.name: _plain(getattr(x, f.name)) for f in fields(x)}
    if isinstance(x, tuple):
        return [_plain(y) for y in x]
    if isinstance(x, Op):
        return {"op": x.value}
    if isinstance(x, bytes | bytearray):
        return {"bytes": base64.b64encode(x).decode()}
    if isinstance(x, decimal.Decimal):
        return {"decimal": str(x)}
    for kind in (dt.datetime, dt.date):
        if isinstance(x, kind):
            return {kind.__name__: x.isoformat()}
    return x


def from_json(text: str) -> Predicate:
    def build(x: Any) -> Any:
        if isinstance(x, list):
            return tuple(build(y) for y in x)
        if not isinstance(x, dict):
            return x
        if "is" in x:
            return _CLASSES[x["is"]](**{k: build(v) for k, v in x.items() if k != "is"})
        (kind, value), = x.items()
        return {"op": Op, "bytes": base64.b64decode, "decimal": decimal.Decimal, "datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat}[kind](value)

    return build(json.loads(text))
