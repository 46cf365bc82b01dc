"""From files and a predicate to what has to be read.

``PruneRequest`` is one request, built step by step. ``Pruner`` holds a schema for many predicates, ``CompiledPruner`` also
the predicate, for many sets of files. Statistics are evaluated first; bloom filters and dictionaries are loaded only for
row groups that these keep; pages cut what is left. All of it is one row for each row group, without a shuffle but for
dictionaries, which are joined.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.errors import PredicateError
from parqsieve.operators import pages as P
from parqsieve.operators import selection
from parqsieve.operators.hints import hints_in, with_hints
from parqsieve.operators.ir import And, Predicate
from parqsieve.operators.rows import is_repeated, row_filter
from parqsieve.operators.tristate import Stats, keep, tristate
from parqsieve.plans.compiler import Compiled, Compiler, SchemaIndex
from parqsieve.sources import footers
from parqsieve.sources.evidence import KEYS, Evidence, FooterEvidence
from parqsieve.sources.rowranges import read_ranges, tasks_for


@dataclass(frozen=True)
class PruneOptions:
    """truncated: use bounds of strings that may be cut short, too."""

    page_index: bool = True
    bitmap: bool = True
    bloom: bool = True
    dictionary: bool = False
    truncated: bool = False


def projection_of(columns: Iterable[str] | None) -> list[str] | None:
    """Sorted, each once, without empty names; None if nothing is left."""
    return sorted({c for c in columns or () if c}) or None


#: Of so few files Spark's own reader looks at all the footers in about the time that a job of ours takes to start.
FEW_FILES = 64


@dataclass(frozen=True)
class PruneResult:
    """What is kept of the files at path; all of it is computed when it is asked for."""

    spark: SparkSession
    path: str | list[str]
    schema: T.StructType
    compiled: Compiled
    options: PruneOptions
    evidence: Evidence = field(repr=False)
    output: list[str] | None = None
    opener: footers.Opener = field(default=footers.open_file, repr=False)
    cache: footers.FooterCache | None = field(default=None, repr=False)

    @functools.cached_property
    def files(self) -> DataFrame:
        """file, length, modified of all files."""
        return footers.list_files(self.spark, self.path)

    @functools.cached_property
    def groups(self) -> DataFrame:
        """file, length, modified, rg, num_rows, ranges (null: the whole group) of what is kept."""
        return decide(self.files, self.schema, self.predicates, self.options, self.evidence, self.opener, self.cache)

    @property
    def predicates(self) -> list[Predicate]:
        return self.compiled.predicates

    @property
    def errors(self) -> list[PredicateError]:
        return self.compiled.errors

    @property
    def predicate_columns(self) -> list[str]:
        return self.compiled.columns

    @property
    def required_columns(self) -> list[str]:
        """Of the output and the predicate; empty if all are needed."""
        if self.output is None or self.errors and not self.predicate_columns:
            return []
        return sorted({*self.output, *self.predicate_columns})

    def row_groups(self) -> DataFrame:
        return self.groups.select("file", "rg", "num_rows")

    def runs(self) -> DataFrame:
        """file, run, start, n, skip; row numbers count within the kept row groups of a file."""
        return selection.runs(self.groups.select("file", "rg", "num_rows", "ranges"))

    def bitmaps(self) -> DataFrame | None:
        """file, bucket, bits, note; None if not asked for. A file with more kept rows than 32 bits can number has one row without bucket and bits, and a note that says so."""
        if not self.options.bitmap:
            return None
        sized = self.groups.withColumn("total", F.sum("num_rows").over(Window.partitionBy("file")))
        made = selection.bitmaps_of_runs(selection.runs(sized.where(F.col("total") <= selection.MOST_ROWS).select("file", "rg", "num_rows", "ranges")))
        long = sized.where(F.col("total") > selection.MOST_ROWS).select("file").distinct()
        note = F.lit(f"more than {selection.MOST_ROWS} rows are kept: no bitmap")
        return made.withColumn("note", F.lit(None).cast("string")).unionByName(long.select("file", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), note.alias("note")))

    def too_long(self) -> DataFrame:
        """The files whose kept rows no bitmap can number."""
        return self.groups.groupBy("file").agg(F.sum("num_rows").alias("rows")).where(F.col("rows") > selection.MOST_ROWS).select("file")

    def parts(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Row groups, runs and bitmaps."""
        return self.row_groups(), self.runs(), self.bitmaps()

    def parts_with_projection(self) -> tuple[DataFrame, DataFrame, DataFrame | None, list[str]]:
        """The same and the required columns."""
        return *self.parts(), self.required_columns

    def totals(self) -> Row:
        """files, groups, pages_rows: how many files, row groups and rows are kept, and n_files of all."""
        selected = F.coalesce(F.aggregate("ranges", F.lit(0).cast("long"), lambda t, r: t + r["n"]), "num_rows")
        return self.groups.agg(F.count_distinct("file").alias("files"), F.count("*").alias("groups"), F.coalesce(F.sum(selected), F.lit(0)).alias("rows")).first()

    def read_schema(self) -> T.StructType:
        """The top-level columns that are required; all if that isn't known."""
        need = {name for path in self.required_columns for name in self.schema.names if path == name or path.startswith(name + ".")}
        return T.StructType([f for f in self.schema.fields if not self.required_columns or f.name in need])

    def exact(self) -> Column:
        """The whole condition. A text goes to Spark as it is, whatever of it could be compiled; one with names that only the schema's leaves explain goes through the predicates."""
        if self.compiled.sql is not None:
            return F.expr(self.compiled.sql)
        if self.errors:
            raise ValueError("parts of the predicate couldn't be compiled, and it has names that Spark doesn't find; give the exact condition")
        return row_filter(And(tuple(self.predicates)), self.schema)

    def scan(self, exact: Column | None = None, reader: str = "files") -> DataFrame:
        """The matching rows of what is kept.

        reader "files": Spark's own reader gets the kept files and the exact condition, which it also pushes down to row groups and pages
        (of up to FEW_FILES files it gets all, since it prunes these as fast). The driver holds the list of kept files, as it holds Spark's list of all. "ranges": tasks in Python read just the kept stretches of
        rows; for evidence that Spark's reader doesn't have.
        """
        if reader == "ranges":
            rows = read_ranges(self.groups, self.read_schema() if not self.errors else self.schema, self.opener, tasks_for(self.files))
        elif reader == "files":
            rows = self.kept_files()
        else:
            raise ValueError(f"reader is files or ranges, not {reader}")
        found = rows.where(self.exact() if exact is None else exact)
        return found.select(*(self.schema.names if self.output is None else [f"`{c}`" if c in self.schema.names else c for c in self.output]))

    def kept_files(self) -> DataFrame:
        """All rows of the files with a kept row group; of a few files, of all. Pages aren't looked at, as Spark's reader does that itself."""
        rows = self.spark.read.schema(self.schema).parquet(*([self.path] if isinstance(self.path, str) else self.path))
        if not self.predicates or (n := len(rows.inputFiles())) <= FEW_FILES:
            return rows
        groups = decide(self.files, self.schema, self.predicates, dataclasses.replace(self.options, page_index=False), self.evidence, self.opener, self.cache)
        kept = [r["name"] for r in groups.select("file").distinct().join(footers.scan_names(self.spark, self.path), "file").select("name").collect()]
        return rows if len(kept) == n else rows.where(F.col("_metadata.file_path").isin(kept) if kept else F.lit(False))


def decide(files: DataFrame, schema: T.StructType, predicates: list[Predicate], options: PruneOptions, evidence: Evidence, opener: footers.Opener, cache: footers.FooterCache | None = None) -> DataFrame:
    """file, length, modified, rg, num_rows, ranges of the row groups that are kept."""
    index = SchemaIndex(schema)
    whole = And(tuple(predicates))
    columns = [(c, index.paths[c]) for c in whole.columns() if c in index.paths]
    place = {c: i for i, (c, _) in enumerate(columns)}
    groups = (cache.row_groups if cache else footers.row_groups)(files, columns, options.page_index, opener)

    def usable(i: int) -> Column:
        return F.coalesce(F.col(f"ordered_{i}") & (F.lit(True) if options.truncated else F.col(f"whole_{i}")), F.lit(False))

    def stats(name: str, **more: object) -> Stats | None:
        if (i := place.get(name)) is None:
            return None
        return Stats(columns[i][1], F.col(f"low_{i}"), F.col(f"high_{i}"), F.col(f"nulls_{i}"), F.col("num_rows"), usable(i), is_repeated(schema, name), **more)

    kept = groups.where(keep(tristate(whole, stats)))
    flat = {c for c in place if not is_repeated(schema, c)}
    hinted = with_hints(whole, place if options.bloom else (), flat if options.dictionary else ())
    blooms, dictionaries = hints_in(hinted, "bloom"), hints_in(hinted, "dictionary")
    asked = {place[c]: (columns[place[c]][1], tuple(dict.fromkeys(v for values in lists for v in values))) for c, lists in blooms.items()}
    if asked:
        kept = evidence.absent(kept, asked)
    for c in dictionaries:
        kept = evidence.with_values(kept, f"values_{place[c]}", c, columns[place[c]][1])
    if asked or dictionaries:

        def absent(name: str, values: tuple) -> Column | None:
            i = place[name]
            return F.array(*[F.get(F.col(f"absent_{i}"), F.lit(asked[i][1].index(v))) for v in values]) if i in asked else None

        def informed(name: str) -> Stats | None:
            i = place.get(name)
            return stats(name, values=F.col(f"values_{i}") if name in dictionaries else None, absent=functools.partial(absent, name))

        kept = kept.where(keep(tristate(hinted, informed)))
    if not options.page_index or not columns:
        return kept.select(*KEYS, "num_rows", F.lit(None).cast("array<struct<first:long,n:long>>").alias("ranges"))

    def paged(name: str) -> P.Pages | None:
        if (i := place.get(name)) is None:
            return None
        return P.Pages(columns[i][1], F.col(f"pages_{i}"), usable(i), F.col(f"nulls_{i}"), True, is_repeated(schema, name))

    starts = P.segments([paged(c) for c, _ in columns if c in flat])
    cut = kept.withColumn("starts", F.when(F.size(starts) > 0, starts).otherwise(F.array(F.lit(0).cast("long"))))
    picked = P.conjunction(predicates, paged, F.col("starts"))
    marked = cut.select(*KEYS, "num_rows", "starts", picked.flags.alias("flags"), picked.supported.alias("supported"))
    ranges = F.when(F.col("supported"), P.ranges(F.col("flags"), F.col("starts"), F.col("num_rows")))
    return marked.select(*KEYS, "num_rows", ranges.alias("ranges")).where("ranges is null or size(ranges) > 0")


@dataclass(frozen=True)
class PruneRequest:
    """PruneRequest(spark, path).where("a > 5").project("b").prune()"""

    spark: SparkSession
    path: str | list[str]
    schema: T.StructType | None = None
    predicate: Predicate | str | None = None
    output: list[str] | None = None
    options: PruneOptions = PruneOptions()
    evidence: Evidence | None = None
    opener: footers.Opener = footers.open_file
    cache: footers.FooterCache | None = None

    def where(self, predicate: Predicate | str) -> PruneRequest:
        return dataclasses.replace(self, predicate=predicate)

    def project(self, *columns: str) -> PruneRequest:
        return dataclasses.replace(self, output=projection_of(columns))

    def option(self, **options: bool) -> PruneRequest:
        return dataclasses.replace(self, options=dataclasses.replace(self.options, **options))

    def with_evidence(self, evidence: Evidence) -> PruneRequest:
        return dataclasses.replace(self, evidence=evidence)

    def with_footers(self, cache: footers.FooterCache) -> PruneRequest:
        return dataclasses.replace(self, cache=cache)

    def prune(self) -> PruneResult:
        """Without a predicate everything is kept. Parts of a text that can't be compiled are errors in the result and keep what they would decide."""
        schema = self.schema or self.spark.read.parquet(*([self.path] if isinstance(self.path, str) else self.path)).schema
        return Pruner(self.spark, schema, self.options, self.evidence, self.opener, self.cache).prune(self.path, self.predicate, self.output)


class Pruner:
    """A schema, for many predicates and files."""

    def __init__(self, spark: SparkSession, schema: T.StructType, options: PruneOptions = PruneOptions(), evidence: Evidence | None = None, opener: footers.Opener = footers.open_file, cache: footers.FooterCache | None = None):
        if not schema.fields:
            raise ValueError("the schema has no columns")
        self.spark, self.schema, self.options, self.opener, self.cache = spark, schema, options, opener, cache
        self.evidence = evidence or FooterEvidence(opener)
        self.compiler = Compiler(spark, schema)

    def compile(self, predicate: Predicate | str | None) -> Compiled:
        if predicate is None:
            return Compiled()
        if isinstance(predicate, str):
            return self.compiler.compile(predicate)
        return Compiled.of(predicate)

    def prune(self, path: str | list[str], predicate: Predicate | str | None = None, output: Iterable[str] | None = None) -> PruneResult:
        return self._prune(path, self.compile(predicate), output)

    def _prune(self, path: str | list[str], compiled: Compiled, output: Iterable[str] | None) -> PruneResult:
        return PruneResult(self.spark, path, self.schema, compiled, self.options, self.evidence, projection_of(output), self.opener, self.cache)

    def try_compile(self, predicate: Predicate | str) -> CompiledPruner:
        """Raises the first error if any part can't be compiled."""
        compiled = self.compile(predicate)
        if compiled.errors:
            raise compiled.errors[0]
        return CompiledPruner(self, compiled)


@dataclass(frozen=True)
class CompiledPruner:
    pruner: Pruner
    compiled: Compiled

    def prune(self, path: str | list[str], output: Iterable[str] | None = None) -> PruneResult:
        return self.pruner._prune(path, self.compiled, output)
