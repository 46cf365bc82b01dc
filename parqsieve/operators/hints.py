"""Puts hints for bloom filters and dictionaries beside = and IN."""

from __future__ import annotations

from collections.abc import Collection

from parqsieve.operators.ir import And, Cmp, Hint, In, Not, Op, Or, Predicate


def with_hints(predicate: Predicate, bloom: Collection[str] = (), dictionary: Collection[str] = (), positive: bool = True) -> Predicate:
    """Only where no odd number of NOTs is above: a hint can say false, and never true."""
    match predicate:
        case And(terms) | Or(terms):
            return type(predicate)(tuple(with_hints(t, bloom, dictionary, positive) for t in terms))
        case Not(term):
            return Not(with_hints(term, bloom, dictionary, not positive))
        case Cmp(column, Op.EQ, value):
            values = (value,)
        case In(column, values):
            pass
        case _:
            return predicate
    known = bool(values) and all(v is not None for v in values)
    hints = [Hint("bloom", column, values)] if known and column in bloom else []
    if known and column in dictionary and all(isinstance(v, str | bytes | bytearray) for v in values):
        hints.append(Hint("dictionary", column, values))
    return And((predicate, *hints)) if positive and hints else predicate


def hints_in(predicate: Predicate, kind: str) -> dict[str, list[tuple]]:
    """The value lists of the hints of a kind, by column, each list once."""
    found: dict[str, list[tuple]] = {}
    todo = [predicate]
    while todo:
        p = todo.pop()
        if isinstance(p, Hint) and p.kind == kind and p.values not in found.setdefault(p.column, []):
            found[p.column].append(p.values)
        todo.extend(p.parts())
    return found
