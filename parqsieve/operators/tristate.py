"""A predicate on statistics, in three-valued logic: false, true and unknown are SQL's false, true and null.

False says that no row matches, true that no row fails to; so NOT is sound. What isn't false is kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.functions.prefix import successor
from parqsieve.operators.ir import And, Between, Cmp, Const, Hint, In, IsNull, Not, Op, Or, Predicate, Prefix
from parqsieve.operators.rows import literal

UNKNOWN = F.lit


@dataclass(frozen=True)
class Stats:
    """Columns with what is known of a leaf (of an interval: bounds as structs of months, days and nanoseconds): least, greatest, nulls (null: unknown), rows; whether bounds may be used (order and exactness); whether it is repeated; evidence arrays."""

    kind: T.DataType
    low: Column
    high: Column
    nulls: Column
    rows: Column
    usable: Column | None = None
    repeated: bool = False
    values: Column | None = None  # dictionary evidence: all values, null if unknown
    absent: Callable[[tuple], Column | None] | None = None  # bloom evidence: literals -> array of booleans
    missing_nulls_are_none: bool = True


Lookup = Callable[[str], Stats | None]


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def keep(tri: Column) -> Column:
    return F.coalesce(tri, F.lit(True))


def tristate(predicate: Predicate, lookup: Lookup) -> Column:
    down = functools.partial(tristate, lookup=lookup)
    match predicate:
        case Const(value):
            return F.lit(value)
        case And(terms):
            return functools.reduce(Column.__and__, map(down, terms), F.lit(True))
        case Or(terms):
            return functools.reduce(Column.__or__, map(down, terms), F.lit(False))
        case Not(term):
            return ~down(term)
    stats = lookup(predicate.column)
    if stats is None:
        return unknown()
    tri = leaf(predicate, stats)
    return F.when(~tri, F.lit(False)) if stats.repeated else tri  # some element may match: never true


def leaf(predicate: Predicate, s: Stats) -> Column:
    match predicate:
        case Cmp(_, op, value):
            return compare(op, value, s)
        case Between():
            low, high = predicate.sides()
            return leaf(low, s) & leaf(high, s)
        case In(_, values):
            if values:
                return one_of(values, s)
            return F.when(s.low.isNotNull() & s.high.isNotNull() & usable(s), F.lit(False))
        case Prefix(_, prefix):
            if not prefix:
                return unknown()
            above = successor(prefix)
            low = compare(Op.GE, prefix, s)
            return low if above is None else low & compare(Op.LT, above, s)
        case IsNull(_, negated):
            if s.repeated:
                return unknown()
            tri = F.when(s.nulls == 0, F.lit(False)).when(s.nulls == s.rows, F.lit(True))
            return ~tri if negated else tri
        case Hint("dictionary", _, values):
            if s.values is None:
                return unknown()
            hits = functools.reduce(Column.__or__, [F.array_contains(s.values, literal(v, s.kind)) for v in values])
            return F.when((F.size(s.values) > 0) & ~hits, F.lit(False))
        case Hint("bloom", _, values):
            absent = s.absent(values) if s.absent else None
            return unknown() if absent is None else F.when(F.forall(absent, lambda x: F.coalesce(x, F.lit(False))) & (F.size(absent) > 0), F.lit(False))
    raise TypeError(f"no predicate: {predicate!r}")


def usable(s: Stats) -> Column:
    return F.lit(True) if s.usable is None else s.usable


def compare(op: Op, value: object, s: Stats) -> Column:
    if isinstance(s.kind, T.CalendarIntervalType):
        return compare_interval(op, value, IntervalStats(s.low, s.high, s.nulls)) if isinstance(value, tuple) else unknown()
    if value is None or value != value:
        return unknown()
    v, low, high = literal(value, s.kind), s.low, s.high
    point, outside = (low == high) & (low == v), (low > v) | (high < v)
    never, always = {
        Op.EQ: (outside, point),
        Op.NE: (point, outside),
        Op.LT: (low >= v, high < v),
        Op.LE: (low > v, high <= v),
        Op.GT: (high <= v, low > v),
        Op.GE: (high < v, low >= v),
    }[op]
    return F.when(~known(s), unknown()).when(never, F.lit(False)).when(always & no_nulls(s), F.lit(True))


def known(s: Stats) -> Column:
    both = s.low.isNotNull() & s.high.isNotNull() & usable(s)
    return both & ~F.isnan(s.low) & ~F.isnan(s.high) if isinstance(s.kind, T.FloatType | T.DoubleType) else both


def no_nulls(s: Stats) -> Column:
    return F.coalesce(s.nulls, F.lit(0)) == 0 if s.missing_nulls_are_none else F.coalesce(s.nulls == 0, F.lit(False))


def one_of(values: tuple, s: Stats) -> Column:
    """The same as = with each of the values, joined by OR, in one pass over an array of them."""
    if isinstance(s.kind, T.CalendarIntervalType):
        return functools.reduce(Column.__or__, [compare(Op.EQ, v, s) for v in values])
    plain = [v for v in values if v is not None and v == v]
    if not plain:
        return unknown()
    simple = all(isinstance(v, int | float | str) for v in plain) and len({type(v) for v in plain}) == 1
    known_values = F.lit(plain).cast(T.ArrayType(s.kind)) if simple else F.array(*[literal(v, s.kind) for v in plain])
    never = ~F.exists(known_values, lambda v: (s.low <= v) & (s.high >= v)) if len(plain) == len(values) else F.lit(False)
    always = (s.low == s.high) & F.array_contains(known_values, s.low)
    return F.when(~known(s), unknown()).when(never, F.lit(False)).when(always & no_nulls(s), F.lit(True))


@dataclass(frozen=True)
class IntervalStats:
    """Bounds of an interval leaf as structs of months, days and nanoseconds."""

    low: Column
    high: Column
    nulls: Column


def compare_interval(op: Op, value: tuple[int, int, int], s: IntervalStats) -> Column:
    """Intervals are decided only where all values of the group are one: equality then is exact, order goes by the parts."""
    v = F.struct(*[F.lit(x).cast("long") for x in value])
    none = F.coalesce(s.nulls, F.lit(0)) == 0
    single = s.low.isNotNull() & s.high.isNotNull() & (s.low == s.high)
    holds = {Op.EQ: s.low == v, Op.NE: s.low != v, Op.LT: s.low < v, Op.LE: s.low <= v, Op.GT: s.low > v, Op.GE: s.low >= v}[op]
    never = ~holds & none if op is Op.NE else ~holds
    return F.when(~single, unknown()).when(never, F.lit(False)).when(holds & none, F.lit(True))
