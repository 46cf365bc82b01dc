"""Logical zone maps: statistics of stretches of a key, by one aggregation."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.operators import pages as P
from parqsieve.operators.ir import And, Predicate
from parqsieve.operators.tristate import Stats, keep, tristate
from parqsieve.sources.scratch import written

MOST_RANGES = 64


def zone_of(key: str, size: int) -> Column:
    """Of whole-numbered keys, exact at any size."""
    return F.expr(f"(`{key}` - pmod(`{key}`, {size}L)) div {size}L")


def zone_maps(df: DataFrame, key: str, size: int, columns: list[str], dictionaries: tuple[str, ...] = ()) -> DataFrame:
    """zone, n, and for the i-th column low_i, high_i, nulls_i; values_i where its dictionary is asked for."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.min(c).alias(f"low_{i}"), F.max(c).alias(f"high_{i}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{i}")]
        if c in dictionaries:
            aggs.append(F.collect_set(c).alias(f"values_{i}"))
    return df.groupBy(zone_of(key, size).alias("zone")).agg(*aggs)


def lookup_in(schema: T.StructType, columns: list[str], dictionaries: tuple[str, ...] = (), kinds: dict[str, T.DataType] = {}):
    def lookup(path: str) -> Stats | None:
        if path not in columns:
            return None
        i = columns.index(path)
        return Stats(kinds.get(path) or schema[path].dataType, F.col(f"low_{i}"), F.col(f"high_{i}"), F.col(f"nulls_{i}"), F.col("n"), values=F.col(f"values_{i}") if path in dictionaries else None)

    return lookup


def decide(df: DataFrame, key: str, size: int, predicate: Predicate, dictionaries: tuple[str, ...] = (), without: tuple[str, ...] = (), kinds: dict[str, T.DataType] | None = None) -> DataFrame:
    """zone, tri, keep. Columns in without have no statistics; kinds are types of predicates on columns that hold them in another form (intervals as structs)."""
    columns = [c for c in predicate.columns() if c not in without]
    made = zone_maps(df, key, size, columns, dictionaries)
    tri = tristate(predicate, lookup_in(df.schema, columns, dictionaries, kinds or {}))
    return made.select("zone", tri.alias("tri"), keep(tri).alias("keep"))


def page_rows(df: DataFrame, key: str, size: int, page: int, predicates: list[Predicate]) -> DataFrame:
    """zone, starts, flags, exact, supported, n: the page selection of each zone, with pages of page keys."""
    columns = And(tuple(predicates)).columns()
    first = (F.floor((F.col(key) % size) / page) * page).cast("long")
    one = df.groupBy(zone_of(key, size).alias("zone"), first.alias("first")).agg(
        F.count("*").alias("n"),
        *[x for i, c in enumerate(columns) for x in (F.min(c).alias(f"low_{i}"), F.max(c).alias(f"high_{i}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"))],
    )
    page_of = lambda i: F.struct("first", F.col(f"low_{i}").alias("low"), F.col(f"high_{i}").alias("high"), F.col(f"nulls_{i}").alias("nulls"), (F.col(f"nulls_{i}") == F.col("n")).alias("null_page"), "n")
    whole = one.groupBy("zone").agg(F.sum("n").alias("n"), *[F.array_sort(F.collect_list(page_of(i))).alias(f"pages_{i}") for i in range(len(columns))], *[F.sum(f"nulls_{i}").alias(f"nulls_{i}") for i in range(len(columns))])

    def lookup(path: str) -> P.Pages | None:
        if path not in columns:
            return None
        i = columns.index(path)
        return P.Pages(df.schema[path].dataType, F.col(f"pages_{i}"), F.lit(True), F.col(f"nulls_{i}"), df.schema[path].nullable)

    cut = whole.withColumn("starts", P.segments([lookup(c) for c in columns]))
    picked = P.conjunction(predicates, lookup, F.col("starts"))
    return cut.select("zone", "n", "starts", picked.flags.alias("flags"), picked.exact.alias("exact"), picked.supported.alias("supported"))


class ZoneIndex:
    """Zone maps of a table in a table of their own, a row for each zone, built once and used by many scans."""

    def __init__(self, df: DataFrame, key: str, size: int, columns: list[str], path: str):
        self.key, self.size, self.columns, self.schema = key, size, columns, df.schema
        self.maps = written(zone_maps(df, key, size, columns), "zones", path)

    def ranges(self, predicate: Predicate, most: int = MOST_RANGES) -> list[tuple[int, int]]:
        """At most ``most`` ranges of zones, ends included, that cover all that are kept: of more, the nearest become one. A task brings no more than that to the driver."""
        tri = tristate(predicate, lookup_in(self.schema, self.columns))
        kept = self.maps.where(keep(tri)).where("zone is not null").select("zone")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[tuple[int, int]] = []
            for b in batches:
                found = joined([*found, *((z, z) for z in b.column(0).to_pylist())], most)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["first", "last"])

        parts = kept.repartitionByRange("zone").sortWithinPartitions("zone").mapInArrow(merge, "first long, last long")
        return joined([tuple(r) for r in parts.collect()], most)

    def keys(self, predicate: Predicate) -> Column:
        """A condition on the key, for a scan to push down, that all matching rows meet; rows without a key aren't in any zone's range and are let through."""
        key, size = F.col(self.key), self.size
        return functools.reduce(Column.__or__, [(key >= first * size) & (key < (last + 1) * size) for first, last in self.ranges(predicate)], key.isNull())


def joined(ranges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    if len(out) > most:
        widest = sorted(range(1, len(out)), key=lambda k: out[k - 1][1] - out[k][0])[: most - 1]
        cuts = [0, *sorted(widest)]
        out = [(out[a][0], out[b - 1][1]) for a, b in itertools.pairwise([*cuts, len(out)])]
    return out


def pruned_scan(df: DataFrame, index: ZoneIndex, predicate: Predicate, row_filter: Column) -> DataFrame:
    """Rows of df that match, one scan with the kept ranges of the key pushed down; the exact filter is always applied."""
    return df.where(index.keys(predicate) & row_filter)
