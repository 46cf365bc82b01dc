"""Footers, page indexes and bloom filters of Parquet files, read where the tasks run.

Spark lists the files (path, length, time; no content). A task then reads the tails of its files and, for the asked leaves
only, the page indexes: one row for each row group, its statistics in the leaf's own type, so that decisions need no
shuffle. Bloom filters are read in a second step, for row groups that statistics keep, a block of 32 bytes for each value.

Files are opened with ``pyarrow.fs``, or with the ``opener`` that is given: a picklable function of a path.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.functions import bloom
from parqsieve.sources.thrift import Reader

Opener = Callable[[str], Any]
PHYSICAL = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")  # fixed values of the Parquet format, as are the field ids below
TAIL = 1 << 16
FILES_IN_TASK = 64
JULIAN_EPOCH = 2_440_588


def open_file(path: str) -> Any:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path))
    return store.open_input_file(inner)


def read_at(file: Any, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, length, modified; together they tell one version of a file from another."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    files = found.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    return files.coalesce(max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // FILES_IN_TASK))


def scan_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and the name that scans know it by (_metadata.file_path), which writes some characters in another way."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("name"))


@dataclass(frozen=True)
class Leaf:
    path: str
    physical: str
    width: int
    optional: bool
    converted: int | None
    scale: int
    unit: str | None
    unsigned: bool


def leaves(elements: list[dict[int, Any]]) -> list[Leaf]:
    """The leaves of a schema in order, lists and maps by their standard names."""
    out, at = [], 1

    def walk(front: str, name: str | None, names: tuple[tuple[str, ...], ...], optional: bool) -> None:
        """name stands for the element's own; names are those of its children, and of theirs."""
        nonlocal at
        e = elements[at]
        at += 1
        converted, logical = e.get(6), e.get(10, {})
        path = ".".join(x for x in (front, name or e[4].decode()) if x)
        maybe = optional or e.get(3) != 0
        if not e.get(5):
            integer, stamp = logical.get(10, {}), logical.get(8, {}).get(2, {})
            unit = {1: "ms", 2: "us", 3: "ns"}.get(next(iter(stamp), None)) or {9: "ms", 10: "us"}.get(converted)
            path = ".".join([path, *(n[0] for n in names)])  # a list without a group for its elements
            out.append(Leaf(path, PHYSICAL[e[1]], e.get(2, 0), maybe, converted, e.get(7, logical.get(5, {}).get(1, 0)), unit, converted in (11, 12, 13, 14) or integer.get(2) is False))
            return
        if converted == 3 or 3 in logical:
            names = (("list",), ("element",))
        elif converted in (1, 2) and not names or 2 in logical:
            names = (("key_value",), ("key", "value"))
        for i in range(e[5]):
            walk(path, names[0][i] if names and i < len(names[0]) else None, names[1:], maybe)

    for _ in range(elements[0].get(5, 0)):
        walk("", None, (), False)
    return out


def footer(file: Any, length: int) -> dict[int, Any]:
    tail = read_at(file, max(0, length - TAIL), min(TAIL, length))
    if len(tail) < 12 or tail[-4:] != b"PAR1":
        raise ValueError("not a Parquet file, or its footer is encrypted")
    n = struct.unpack("<I", tail[-8:-4])[0]
    if n + 8 > length:
        raise ValueError("the footer is longer than the file")
    return Reader(tail[-8 - n : -8] if n + 8 <= len(tail) else read_at(file, length - 8 - n, n)).struct()


def decoded(raw: bytes | None, leaf: Leaf, kind: T.DataType) -> Any:
    """A bound as Arrow takes it for the Spark type: dates as days, timestamps as microseconds. None where the two don't fit."""
    if raw is None:
        return None
    p = leaf.physical
    try:
        if isinstance(kind, T.StringType):
            return raw.decode() if p in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY") else None
        if isinstance(kind, T.BinaryType):
            return raw if p == "BYTE_ARRAY" or p == "FIXED_LEN_BYTE_ARRAY" and len(raw) == leaf.width else None
        if p == "BOOLEAN":
            return bool(raw[0]) if isinstance(kind, T.BooleanType) else None
        if p in ("FLOAT", "DOUBLE"):
            return struct.unpack("<f" if p == "FLOAT" else "<d", raw)[0] if isinstance(kind, T.FloatType | T.DoubleType) else None
        if p == "INT96":
            nanos, day = struct.unpack("<qi", raw)
            return (day - JULIAN_EPOCH) * 86_400_000_000 + nanos // 1000 if isinstance(kind, T.TimestampType | T.TimestampNTZType) else None
        if p in ("INT32", "INT64"):
            size = 4 if p == "INT32" else 8
            number = int.from_bytes(raw, "little", signed=not leaf.unsigned) if len(raw) == size else None
        elif isinstance(kind, T.DecimalType):
            number = int.from_bytes(raw, "big", signed=True)
        else:
            return None
        if number is None:
            return None
        if isinstance(kind, T.DecimalType):
            scale = 0 if leaf.unsigned else leaf.scale
            with decimal.localcontext() as c:
                c.prec = 76
                return decimal.Decimal(number).scaleb(-scale).quantize(decimal.Decimal(1).scaleb(-kind.scale)) if scale <= kind.scale else None
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            return {"ms": number * 1000, "us": number}.get(leaf.unit)
        if isinstance(kind, T.DateType):
            return number if p == "INT32" else None
        if isinstance(kind, T.IntegralType):
            bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind.simpleString()]
            return number if -(1 << bits - 1) <= number < 1 << bits - 1 else None
    except (UnicodeDecodeError, struct.error, ArithmeticError, IndexError):
        return None
    return None


def arrow_type(kind: T.DataType) -> pa.DataType | None:
    match kind:
        case T.DecimalType():
            return pa.decimal128(kind.precision, kind.scale)
        case T.TimestampType():
            return pa.timestamp("us", "UTC")
        case T.TimestampNTZType():
            return pa.timestamp("us")
    return {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "date": pa.date32()}.get(kind.simpleString())


def bounds(stats: dict[int, Any], leaf: Leaf, order_known: bool) -> tuple[bytes | None, bytes | None, bool, bool]:
    """Least, greatest, whether their order may be relied on, whether they are whole values."""
    by_bytes = leaf.physical in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
    if by_bytes:  # the older fields 1 and 2 have an unknown order there
        return stats.get(6), stats.get(5), order_known and leaf.converted != 21, bool(stats.get(7)) and bool(stats.get(8))
    return stats.get(6, stats.get(2)), stats.get(5, stats.get(1)), True, True


def page_list(file: Any, chunk: dict[int, Any], leaf: Leaf, kind: T.DataType, rows: int) -> list[dict[str, Any]] | None:
    """The pages of a column chunk; None if it has no index, or one that can't be read."""
    if not (chunk.get(4) and chunk.get(5) and chunk.get(6) and chunk.get(7)):
        return None
    try:
        index = Reader(read_at(file, chunk[6], chunk[7])).struct()
        first = [x[3] for x in Reader(read_at(file, chunk[4], chunk[5])).struct()[1]]
        empty, lows, highs, nulls = index[1], index[2], index[3], index.get(5) or [None] * len(first)
    except (OSError, ValueError, IndexError, KeyError):
        return None
    if not len(first) == len(empty) == len(lows) == len(highs) == len(nulls):
        return None
    made = []
    for i, end in enumerate([*first[1:], rows]):
        if end > first[i]:  # a page without rows has no place
            low, high = (None, None) if empty[i] else (decoded(lows[i], leaf, kind), decoded(highs[i], leaf, kind))
            made.append({"first": first[i], "low": low, "high": high, "nulls": nulls[i], "null_page": empty[i], "n": end - first[i]})
    return made


def row_groups(files: DataFrame, columns: list[tuple[str, T.DataType]], pages: bool = True, opener: Opener = open_file) -> DataFrame:
    """file, length, modified, rg, num_rows, and for the i-th column: low_i, high_i, nulls_i, ordered_i, whole_i, optional_i, bloom_i (place of its filter), physical_i, pages_i.

    A leaf that a file lacks, or stores in another way, has nulls there. Row groups without rows stay out.
    """
    kinds = [(p, k, arrow_type(k)) for p, k in columns]
    fields = [pa.field("file", pa.string()), pa.field("length", pa.int64()), pa.field("modified", pa.timestamp("us", "UTC")), pa.field("rg", pa.int32()), pa.field("num_rows", pa.int64())]
    spark_fields = [T.StructField("file", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType()), T.StructField("rg", T.IntegerType()), T.StructField("num_rows", T.LongType())]
    for i, (_, kind, held) in enumerate(kinds):
        shown = kind if held else T.BinaryType()
        page = T.StructType([T.StructField(n, t) for n, t in (("first", T.LongType()), ("low", shown), ("high", shown), ("nulls", T.LongType()), ("null_page", T.BooleanType()), ("n", T.LongType()))])
        arrow_page = pa.struct([("first", pa.int64()), ("low", held or pa.binary()), ("high", held or pa.binary()), ("nulls", pa.int64()), ("null_page", pa.bool_()), ("n", pa.int64())])
        for name, t, a in (("low", shown, held or pa.binary()), ("high", shown, held or pa.binary()), ("nulls", T.LongType(), pa.int64()), ("ordered", T.BooleanType(), pa.bool_()), ("whole", T.BooleanType(), pa.bool_()), ("optional", T.BooleanType(), pa.bool_()), ("bloom", T.LongType(), pa.int64()), ("physical", T.StringType(), pa.string()), ("pages", T.ArrayType(page), pa.list_(arrow_page))):
            spark_fields.append(T.StructField(f"{name}_{i}", t))
            fields.append(pa.field(f"{name}_{i}", a))
    schema = pa.schema(fields)

    def of_file(path: str, length: int, modified: Any) -> Iterator[dict[str, Any]]:
        with opener(path) as file:
            meta = footer(file, length)
            known = leaves(meta[2])
            place = {leaf.path: n for n, leaf in enumerate(known)}
            orders = meta.get(7) or []
            for rg, group in enumerate(meta.get(4) or []):
                row = {"file": path, "length": length, "modified": modified, "rg": rg, "num_rows": group[3]}
                for i, (name, kind, held) in enumerate(kinds):
                    if (at := place.get(name)) is None or not held:
                        continue
                    leaf, chunk = known[at], group[1][at]
                    stats = chunk[3].get(12, {})
                    low, high, ordered, whole = bounds(stats, leaf, at < len(orders) and 1 in orders[at])
                    row |= {f"low_{i}": decoded(low, leaf, kind), f"high_{i}": decoded(high, leaf, kind), f"nulls_{i}": stats.get(3), f"ordered_{i}": ordered, f"whole_{i}": whole, f"optional_{i}": leaf.optional, f"bloom_{i}": chunk[3].get(14), f"physical_{i}": leaf.physical}
                    row[f"pages_{i}"] = page_list(file, chunk, leaf, kind, group[3]) if pages else None
                if group[3]:
                    yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, modified in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows = list(of_file(path, length, modified))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, T.StructType(spark_fields))


def stored(value: Any, physical: str, kind: T.DataType) -> Any:
    """A literal as the file holds it; None if its bytes aren't known for sure."""
    if isinstance(kind, T.DateType) and type(value) is dt.date:
        return (value - dt.date(1970, 1, 1)).days
    if isinstance(kind, T.IntegralType) and isinstance(value, int) or isinstance(kind, T.FloatType | T.DoubleType | T.StringType | T.BinaryType):
        return value
    return None


def absent_values(groups: DataFrame, asked: dict[int, tuple[T.DataType, tuple]], opener: Opener = open_file) -> DataFrame:
    """groups with absent_i for each asked column i: an array with true for each value that isn't in the row group, null where that is unknown."""
    names = [f"absent_{i}" for i in asked]
    out = T.StructType([*groups.schema.fields, *[T.StructField(n, T.ArrayType(T.BooleanType())) for n in names]])
    at_file, places = groups.columns.index("file"), {i: (groups.columns.index(f"bloom_{i}"), groups.columns.index(f"physical_{i}")) for i in asked}

    def probe(file: Any, at: int | None, physical: str | None, kind: T.DataType, values: tuple) -> list[bool | None]:
        hashes = [bloom.hash_of(stored(v, physical, kind), physical) if at else None for v in values]
        if not any(h is not None for h in hashes):
            return [None] * len(values)
        try:
            head = Reader(read_at(file, at, 64))
            header = head.struct()
            known = 1 in header.get(2, {}) and 1 in header.get(3, {}) and 1 in header.get(4, {})
            return [None if h is None or not known else not bloom.in_block(h, read_at(file, at + head.at + bloom.block_of(h, header[1]), bloom.BLOCK)) for h in hashes]
        except (OSError, ValueError, IndexError, KeyError, struct.error):
            return [None] * len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, found = b.column(at_file).to_pylist(), [[] for _ in names]
            where = {i: (b.column(x).to_pylist(), b.column(y).to_pylist()) for i, (x, y) in places.items()}
            last, file = None, None
            for r, path in enumerate(files):
                if path != last:
                    if file is not None:
                        file.close()
                    file, last = opener(path), path
                for k, (i, (kind, values)) in enumerate(asked.items()):
                    found[k].append(probe(file, where[i][0][r], where[i][1][r], kind, values))
            if file is not None:
                file.close()
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.list_(pa.bool_())) for x in found]], names=[*b.schema.names, *names])

    return groups.mapInArrow(run, out)


class FooterCache:
    """Keeps what row_groups reads in tables below ``store`` (a folder that all machines see), by version of file, so that files are opened once for many predicates.

    One table for each set of columns and choice of pages; a file whose length or time differs is read anew, and its old rows are
    no longer found. The files in the store are its owner's to delete."""

    def __init__(self, store: str):
        self.store, self.parts = store.rstrip("/"), {}

    def row_groups(self, files: DataFrame, columns: list[tuple[str, T.DataType]], pages: bool = True, opener: Opener = open_file) -> DataFrame:
        spark, version = files.sparkSession, ["file", "length", "modified"]
        key = (tuple((c, k.simpleString()) for c, k in columns), pages)
        parts = self.parts.setdefault(key, [])
        schema = row_groups(files, columns, pages, opener).schema
        missing = files.join(spark.read.schema(schema).parquet(*parts).select(*version).distinct(), version, "left_anti") if parts else files
        if not missing.isEmpty():
            part = f"{self.store}/footers-{uuid.uuid4().hex}"
            row_groups(missing, columns, pages, opener).write.parquet(part)
            parts.append(part)
        if not parts:
            return row_groups(files, columns, pages, opener)
        return spark.read.schema(schema).parquet(*parts).join(files, version, "left_semi").select(*schema.names)
