"""The exact row filter of a predicate, as a Catalyst expression."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.errors import ColumnNotFound
from parqsieve.operators.ir import And, Between, Cmp, Const, Hint, In, IsNull, Not, Op, Or, Predicate, Prefix

COMPARE = {Op.EQ: Column.__eq__, Op.NE: Column.__ne__, Op.LT: Column.__lt__, Op.LE: Column.__le__, Op.GT: Column.__gt__, Op.GE: Column.__ge__}


def leaf_of(schema: T.StructType, path: str) -> tuple[list[tuple[str, str]], T.DataType]:
    """The steps of a dotted path ("field", name), ("element", ""), ("key", ""), ("value", "") and the type of its leaf. Lists are x.list.element, maps m.key_value.key."""
    kind, steps, rest = schema, [], path.split(".")
    while rest:
        if isinstance(kind, T.StructType):
            for n in range(len(rest), 0, -1):  # a name may hold dots
                if (name := ".".join(rest[:n])) in kind.names:
                    break
            else:
                raise ColumnNotFound(path)
            steps.append(("field", name))
            kind, rest = kind[name].dataType, rest[n:]
        elif isinstance(kind, T.ArrayType) and rest[0] == "list" and len(rest) > 1:
            steps.append(("element", ""))
            kind, rest = kind.elementType, rest[2:]
        elif isinstance(kind, T.MapType) and len(rest) > 1 and rest[1] in ("key", "value"):
            steps.append((rest[1], ""))
            kind, rest = kind.keyType if rest[1] == "key" else kind.valueType, rest[2:]
        else:
            raise ColumnNotFound(path)
    return steps, kind


def is_repeated(schema: T.StructType, path: str) -> bool:
    return any(kind != "field" for kind, _ in leaf_of(schema, path)[0])


def literal(value: object, kind: T.DataType) -> Column:
    """A constant of the type. Timestamps don't go through Python's own time zone: aware ones are instants, naive ones mean the session's zone."""
    if isinstance(value, bytes | bytearray):
        return F.lit(bytes(value))
    if isinstance(value, dt.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ") + (value.strftime("%z") and f"{value.strftime('%z')[:3]}:{value.strftime('%z')[3:5]}")
        return F.lit(text).cast("timestamp" if value.tzinfo else kind).cast(kind)
    return F.lit(value).cast(kind)


def row_filter(predicate: Predicate, schema: T.StructType) -> Column:
    """True, false or null for each row, by SQL's three-valued logic. On a list or map leaf it asks whether some element matches."""
    down = functools.partial(row_filter, schema=schema)
    match predicate:
        case Const(value):
            return F.lit(value)
        case Hint():
            return F.lit(True)
        case And(terms):
            return functools.reduce(Column.__and__, map(down, terms), F.lit(True))
        case Or(terms):
            return functools.reduce(Column.__or__, map(down, terms), F.lit(False))
        case Not(term):
            return ~down(term)
        case Between():
            low, high = predicate.sides()
            return down(low) & down(high) if not is_repeated(schema, predicate.column) else at_leaf(schema, predicate)
        case _:
            return at_leaf(schema, predicate)


def at_leaf(schema: T.StructType, predicate: Predicate) -> Column:
    steps, kind = leaf_of(schema, predicate.column)

    def test(c: Column) -> Column:
        match predicate:
            case Cmp(_, op, value):
                return COMPARE[op](c, literal(value, kind))
            case Between(_, low, high, inclusive):
                return (c >= literal(low, kind)) & (c <= literal(high, kind)) if inclusive else (c > literal(low, kind)) & (c < literal(high, kind))
            case In(_, values):
                return c.isin(*[literal(v, kind) for v in values]) if values else F.lit(False)
            case Prefix(_, prefix):
                return c.startswith(prefix)
            case IsNull(_, negated):
                return c.isNotNull() if negated else c.isNull()
        raise TypeError(f"no predicate: {predicate!r}")

    def walk(c: Column | None, rest: list[tuple[str, str]]) -> Column:
        if not rest:
            return test(c)
        (how, name), *more = rest
        if how == "field":
            return walk(F.col(f"`{name}`") if c is None else c.getField(name), more)
        many = c if how == "element" else F.map_keys(c) if how == "key" else F.map_values(c)
        return F.exists(many, lambda x: walk(x, more))

    return walk(None, steps)
