"""A predicate on pages: which stretches of rows of a row group have to be read.

All pages of the leaves in question cut the row group into segments. Every node of a predicate becomes three columns of
the row group: an array with a flag for each segment (read it), whether that selection is exact, and whether the node is
supported at all. No join, no shuffle: higher-order functions over the arrays of pages.
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
from parqsieve.operators.tristate import Stats, keep, leaf


@dataclass(frozen=True)
class Pages:
    """pages: array of structs first, low, high, nulls, null_page (and n, rows) of a leaf, null if it has no page index; usable: bounds may be used; nulls: of the row group; nullable: by its schema."""

    kind: T.DataType
    pages: Column
    usable: Column
    nulls: Column
    nullable: bool = True
    repeated: bool = False


@dataclass(frozen=True)
class Selection:
    """flags: array of booleans by segment; exact and supported: one for the row group."""

    flags: Column
    exact: Column
    supported: Column


PageLookup = Callable[[str], Pages | None]


def segments(columns: list[Pages]) -> Column:
    """The first rows of all segments, in order."""
    starts = [F.coalesce(F.transform(p.pages, lambda x: x["first"]), F.array().cast("array<long>")) for p in columns]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*starts)))) if starts else F.array().cast("array<long>")


def select(predicate: Predicate, lookup: PageLookup, starts: Column) -> Selection:
    down = functools.partial(select, lookup=lookup, starts=starts)
    everything = F.transform(starts, lambda s: F.lit(True))
    none = Selection(everything, F.lit(False), F.lit(False))
    match predicate:
        case Const() | Hint():
            return none
        case And(terms):
            parts = [down(t) for t in terms]
            if not parts:
                return none
            flags = functools.reduce(lambda a, b: F.zip_with(a, b, Column.__and__), [F.when(p.supported, p.flags).otherwise(everything) for p in parts])
            exact = functools.reduce(Column.__and__, [p.exact & p.supported for p in parts])
            return Selection(flags, exact, functools.reduce(Column.__or__, [p.supported for p in parts]))
        case Between():
            return down(And(predicate.sides()))
        case Or(terms):
            return either([down(t) for t in terms], none)
        case In(column, values):
            return either([down(Cmp(column, Op.EQ, v)) for v in values], none)
        case Prefix(column, prefix):
            if not prefix:
                return none
            above, low = successor(prefix), down(Cmp(column, Op.GE, prefix))
            return Selection(low.flags, F.lit(False), low.supported) if above is None else down(And((Cmp(column, Op.GE, prefix), Cmp(column, Op.LT, above))))
        case Not(term):
            inner = down(term)
            return Selection(F.transform(inner.flags, lambda x: ~x), inner.exact, inner.supported & inner.exact)
    found = lookup(predicate.column)
    if found is None or found.repeated:
        return none
    usable = F.lit(True) if isinstance(predicate, IsNull) else F.coalesce(found.usable, F.lit(False))
    supported = found.pages.isNotNull() & usable
    states = F.transform(starts, lambda s: state(predicate, found, F.element_at(F.filter(found.pages, lambda p: p["first"] <= s), -1)))
    exact = F.coalesce(F.forall(states, lambda x: x.isNotNull()), F.lit(False))
    return Selection(F.transform(states, keep), exact, supported)


def either(parts: list[Selection], none: Selection) -> Selection:
    """All or nothing."""
    if not parts:
        return none
    flags = functools.reduce(lambda a, b: F.zip_with(a, b, Column.__or__), [p.flags for p in parts])
    return Selection(flags, functools.reduce(Column.__and__, [p.exact for p in parts]), functools.reduce(Column.__and__, [p.supported for p in parts]))


def state(predicate: Predicate, found: Pages, page: Column) -> Column:
    if isinstance(predicate, IsNull):
        tri = F.when(page["null_page"], F.lit(True)).when(page["nulls"] == 0, F.lit(False))
        return ~tri if predicate.negated else tri
    nulls = F.coalesce(page["nulls"], F.when(found.nulls == 0, F.lit(0)))
    stats = Stats(found.kind, page["low"], page["high"], nulls, page["n"], missing_nulls_are_none=not found.nullable)
    return F.when(page["null_page"], F.lit(None).cast("boolean")).otherwise(leaf(predicate, stats))


def conjunction(predicates: list[Predicate], lookup: PageLookup, starts: Column) -> Selection:
    """The selection of all predicates together; unsupported ones select everything."""
    return select(And(tuple(predicates)), lookup, starts)


def ranges(flags: Column, starts: Column, rows: Column) -> Column:
    """Array of structs (first, n) of the maximal runs of selected rows."""
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(rows.cast("long")))
    kind = "array<struct<first:long,n:long>>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        piece = F.struct(x["s"].alias("first"), (x["e"] - x["s"]).alias("n"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), (x["e"] - last["first"]).alias("n"))))
        touches = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["first"] + F.get(done, F.size(done) - 1)["n"] == x["s"])
        return F.when(~x["f"], done).when(touches, grown).otherwise(F.concat(done, F.array(piece)))

    rowsets = F.transform(flags, lambda f, i: F.struct(F.get(starts, i).alias("s"), F.get(ends, i).alias("e"), f.alias("f")))
    return F.aggregate(rowsets, F.array().cast(kind), lambda d, x: F.when(F.size(d) == 0, F.when(x["f"], F.array(F.struct(x["s"].alias("first"), (x["e"] - x["s"]).alias("n")))).otherwise(d)).otherwise(add(d, x)))
