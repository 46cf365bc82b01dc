"""The registered queries of the engine and their DuckDB SQL.

``filter_*`` are exact row filters, ``rg_*`` decisions on zones of a key, ``page_*`` on pages within zones, ``dict_*``
with dictionary evidence, ``zone_scan`` a scan with the kept zones pushed down. ``pruned_scan`` and ``footer_*`` go by the
files' own metadata: statistics as the footers hold them, and scans of what these keep. ``kept_*`` show what is kept of files
with many row groups, pages and bloom filters, which are written from ``orders`` first: groups, stretches of rows, runs and
bitmaps. ``sql_*`` are conditions given as text.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.operators import ir, selection
from parqsieve.operators.hints import with_hints
from parqsieve.operators.ir import Hint, Op, Predicate
from parqsieve.operators.rows import row_filter
from parqsieve.plans.compiler import Compiler
from parqsieve.plans.pruner import PruneOptions, PruneRequest, PruneResult, Pruner
from parqsieve.plans.zonemap import ZoneIndex, decide, page_rows, pruned_scan, zone_of
from parqsieve.sources.evidence import CachedEvidence, Evidence, ScannedEvidence
from parqsieve.sources.footers import list_files, row_groups
from parqsieve.sources.scratch import scratch_path

FLAGSHIP = "pruned_scan"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ZONE, PAGE = 1000, 250
#: Tables of the test data hold no nulls, so some are derived.
NULLABLE = "CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 3000 < 250 THEN NULL ELSE o_totalprice END"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("p", F.expr(NULLABLE))


def sql_value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bytes):
        return "'" + v.decode() + "'::BLOB"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    return str(v)


def _filter(name: str, table: str, columns: str, predicate: Predicate, where: str, source: str = "*") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*source.split(", ", 1), *([f"{NULLABLE} AS p"] if table == "orders" else []))
        return df.where(row_filter(predicate, df.schema)).selectExpr(*columns.split(", "))

    QUERIES[name] = run
    inner = f"SELECT {source}{f', {NULLABLE} AS p' if table == 'orders' else ''} FROM {table}"
    ORACLE_SQL[name] = f"SELECT {columns} FROM ({inner}) AS t WHERE {where}"


O = "o_orderkey, o_totalprice"
for _name, _p, _w in (
    ("filter_eq", ir.eq("o_orderkey", 3500), "o_orderkey = 3500"),
    ("filter_ne", ir.ne("o_orderstatus", "F"), "o_orderstatus <> 'F'"),
    ("filter_lt", ir.lt("p", 5000.0), "p < 5000"),
    ("filter_le", ir.le("o_orderkey", 99), "o_orderkey <= 99"),
    ("filter_gt", ir.gt("p", 400000.0), "p > 400000"),
    ("filter_ge", ir.ge("o_totalprice", 400000.0), "o_totalprice >= 400000"),
    ("filter_between_incl", ir.between("o_orderkey", 100, 200), "o_orderkey BETWEEN 100 AND 200"),
    ("filter_between_excl", ir.between("o_orderkey", 100, 200, False), "o_orderkey > 100 AND o_orderkey < 200"),
    ("filter_in", ir.in_list("o_orderkey", [5, 50, 500, 99999999]), "o_orderkey IN (5, 50, 500, 99999999)"),
    ("filter_in_empty", ir.in_list("o_orderkey", []), "false"),
    ("filter_prefix", ir.starts_with("o_orderpriority", "1-"), "o_orderpriority LIKE '1-%'"),
    ("filter_is_null", ir.is_null("p"), "p IS NULL"),
    ("filter_is_not_null", ir.is_not_null("p"), "p IS NOT NULL"),
    ("filter_and", ir.all_of(ir.gt("p", 300000.0), ir.eq("o_orderstatus", "O")), "p > 300000 AND o_orderstatus = 'O'"),
    ("filter_or", ir.any_of(ir.gt("p", 450000.0), ir.lt("o_orderkey", 10)), "p > 450000 OR o_orderkey < 10"),
    ("filter_not", ir.negate(ir.any_of(ir.gt("p", 1500.0), ir.is_null("p"))), "NOT (p > 1500 OR p IS NULL)"),
    ("filter_true", ir.TRUE, "true"),
    ("filter_false", ir.FALSE, "false"),
    ("filter_date", ir.ge("o_orderdate", dt.date(2001, 7, 1)), "o_orderdate >= DATE '2001-07-01'"),
    ("filter_timestamp", ir.lt("o_orderdate", dt.datetime(1995, 2, 1)), "o_orderdate < TIMESTAMP '1995-02-01'"),
):
    _filter(_name, "orders", O, _p, _w)
_filter("filter_decimal", "lineitem", "l_orderkey, l_linenumber", ir.gt("d", decimal.Decimal("90000.50")), "d > 90000.50", "*, CAST(l_extendedprice AS DECIMAL(12,2)) AS d")
_filter("filter_list_exists", "embeddings", "vec_id", ir.gt("embedding.list.element", 0.3), "len(list_filter(embedding, lambda x: x > 0.3::FLOAT)) > 0")
_filter("projection_required", "customer", "c_custkey", ir.lt("c_acctbal", 0.0), "c_acctbal < 0")


def tri_sql(p: Predicate, mark: str = "") -> str:
    """The three-valued decision in SQL, over low_c, high_c, nulls_c, n (with a mark for pages)."""
    many = lambda word, terms, empty: "(" + f" {word} ".join(tri_sql(t, mark) for t in terms) + ")" if terms else empty
    match p:
        case ir.Const(value):
            return str(value).upper()
        case ir.And(terms):
            return many("AND", terms, "TRUE")
        case ir.Or(terms):
            return many("OR", terms, "FALSE")
        case ir.Not(term):
            return f"(NOT {tri_sql(term, mark)})"
        case ir.Between():
            return many("AND", p.sides(), "")
        case ir.In(c, values):
            return many("OR", [ir.eq(c, v) for v in values], f"(CASE WHEN low_{c} IS NOT NULL THEN FALSE END)")
        case ir.Prefix(c, prefix):
            return many("AND", [ir.ge(c, prefix), ir.lt(c, prefix[:-1] + chr(ord(prefix[-1]) + 1))], "")
        case ir.IsNull(c, negated):
            return ("(NOT " if negated else "(") + f"CASE WHEN nulls_{c} = 0 THEN FALSE WHEN nulls_{c} = n THEN TRUE END)"
        case Hint(_, c, values):
            return f"(CASE WHEN len(values_{c}) > 0 AND NOT list_has_any(values_{c}, [{', '.join(map(sql_value, values))}]) THEN FALSE END)"
    c, v = p.column, sql_value(p.value)
    low, high, none = f"low_{c}", f"high_{c}", f"nulls_{c} = 0"
    never, always = {
        Op.EQ: (f"{low} > {v} OR {high} < {v}", f"{low} = {high} AND {low} = {v}"),
        Op.NE: (f"{low} = {high} AND {low} = {v}", f"({low} > {v} OR {high} < {v})"),
        Op.LT: (f"{low} >= {v}", f"{high} < {v}"),
        Op.LE: (f"{low} > {v}", f"{high} <= {v}"),
        Op.GT: (f"{high} <= {v}", f"{low} > {v}"),
        Op.GE: (f"{high} < {v}", f"{low} >= {v}"),
    }[p.op]
    return f"(CASE WHEN {low} IS NULL OR {high} IS NULL THEN NULL WHEN {never} THEN FALSE WHEN {always} AND {none} THEN TRUE END)"


def stats_sql(columns: list[str], dictionaries: tuple[str, ...] = ()) -> str:
    return "".join(f", min({c}) AS low_{c}, max({c}) AS high_{c}, count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}" + (f", list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL) AS values_{c}" if c in dictionaries else "") for c in columns)


def _zones(name: str, predicate: Predicate, dictionaries: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: decide(orders(spark, sf_dir), "o_orderkey", ZONE, predicate, dictionaries, without)
    tri = "CAST(NULL AS BOOLEAN)" if without else tri_sql(predicate)
    columns = [] if without else predicate.columns()
    ORACLE_SQL[name] = f"WITH z AS (SELECT CAST(floor(o_orderkey / {ZONE}) AS BIGINT) AS zone, count(*) AS n{stats_sql(columns, dictionaries)} FROM (SELECT *, {NULLABLE} AS p FROM orders) AS t GROUP BY 1) SELECT zone, {tri} AS tri, coalesce({tri}, TRUE) AS keep FROM z"


for _name, _p in (
    ("rg_eq", ir.eq("o_orderkey", 3500)),
    ("rg_ne", ir.ne("o_orderstatus", "O")),
    ("rg_lt", ir.lt("o_orderkey", 3500)),
    ("rg_le", ir.le("o_orderkey", 2999)),
    ("rg_gt", ir.gt("p", 499000.0)),
    ("rg_ge", ir.ge("o_orderkey", 3000)),
    ("rg_between", ir.between("o_orderkey", 2500, 4500)),
    ("rg_between_excl", ir.between("o_orderkey", 1999, 3000, False)),
    ("rg_in", ir.in_list("o_orderkey", [5, 7777])),
    ("rg_in_empty", ir.in_list("o_orderkey", [])),
    ("rg_prefix", ir.starts_with("o_orderpriority", "9-")),
    ("rg_is_null", ir.is_null("p")),
    ("rg_is_not_null", ir.is_not_null("o_totalprice")),
    ("rg_and", ir.all_of(ir.gt("p", 499000.0), ir.lt("o_orderkey", 5000))),
    ("rg_or", ir.any_of(ir.lt("o_orderkey", 1000), ir.ge("o_orderkey", 9000))),
    ("rg_not", ir.negate(ir.lt("o_orderkey", 3500))),
    ("rg_timestamp", ir.gt("o_orderdate", dt.datetime(2001, 7, 31))),
    ("rg_true", ir.all_of()),
    ("rg_false", ir.any_of()),
):
    _zones(_name, _p)
_zones("rg_missing_stats", ir.eq("o_orderkey", 3500), without=("o_orderkey",))
_zones("dict_eq", ir.all_of(ir.eq("o_orderpriority", "3-NONE"), Hint("dictionary", "o_orderpriority", ("3-NONE",))), ("o_orderpriority",))
_zones("dict_in", ir.all_of(ir.in_list("o_orderpriority", ["2-A", "4-B"]), Hint("dictionary", "o_orderpriority", ("2-A", "4-B"))), ("o_orderpriority",))


def page_sql(p: Predicate, leaves: list[str]) -> tuple[str, str, str]:
    """(flag, exact, supported) in SQL by page; leaves gathers the leaf decisions t0, t1, ..."""
    match p:
        case ir.And(terms):
            parts = [page_sql(t, leaves) for t in terms]
            return " AND ".join(f"(NOT ({s}) OR ({f}))" for f, _, s in parts), " AND ".join(f"(({e}) AND ({s}))" for _, e, s in parts), " OR ".join(f"({s})" for *_, s in parts)
        case ir.Or(terms):
            parts = [page_sql(t, leaves) for t in terms]
            return " OR ".join(f"({f})" for f, *_ in parts), " AND ".join(f"({e})" for _, e, _ in parts), " AND ".join(f"({s})" for *_, s in parts)
        case ir.Not(term):
            f, e, s = page_sql(term, leaves)
            return f"NOT ({f})", e, f"({s}) AND ({e})"
        case ir.Const():
            return "TRUE", "FALSE", "FALSE"
    leaves.append(tri_sql(p))
    k = len(leaves) - 1
    return f"coalesce(t{k}, TRUE)", f"e{k}", "TRUE"


def _pages(name: str, *predicates: Predicate) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = page_rows(orders(spark, sf_dir), "o_orderkey", ZONE, PAGE, list(predicates))
        return made.select("zone", "exact", "supported", F.explode(F.arrays_zip("starts", "flags")).alias("x")).select("zone", F.col("x.starts").alias("first_row"), F.col("x.flags").alias("selected"), "exact", "supported")

    QUERIES[name] = run
    leaves: list[str] = []
    both = ir.And(tuple(predicates))
    flag, exact, supported = page_sql(both, leaves)
    ORACLE_SQL[name] = f"""WITH g AS (SELECT CAST(floor(o_orderkey / {ZONE}) AS BIGINT) AS zone, CAST(floor(o_orderkey % {ZONE} / {PAGE}) * {PAGE} AS BIGINT) AS first_row, count(*) AS n{stats_sql(both.columns())} FROM (SELECT *, {NULLABLE} AS p FROM orders) AS t GROUP BY 1, 2),
t AS (SELECT zone, first_row, {', '.join(f'{x} AS t{k}' for k, x in enumerate(leaves))} FROM g),
e AS (SELECT *, {', '.join(f'bool_and(t{k} IS NOT NULL) OVER (PARTITION BY zone) AS e{k}' for k in range(len(leaves)))} FROM t)
SELECT zone, first_row, {flag} AS selected, {exact} AS exact, {supported} AS supported FROM e"""


for _name, _ps in (
    ("page_cmp", [ir.gt("o_orderkey", 3499)]),
    ("page_and_best_effort", [ir.gt("o_orderkey", 3499), ir.TRUE]),
    ("page_or", [ir.any_of(ir.lt("o_orderkey", 1250), ir.gt("p", 499000.0))]),
    ("page_or_all_or_nothing", [ir.any_of(ir.lt("o_orderkey", 1250), ir.FALSE)]),
    ("page_not_exact", [ir.negate(ir.lt("o_orderkey", 3500))]),
    ("page_not_inexact", [ir.negate(ir.lt("o_orderkey", 3600))]),
    ("page_is_null", [ir.is_null("p")]),
    ("page_is_not_null", [ir.is_not_null("p")]),
):
    _pages(_name, *_ps)


def _zone_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, p = orders(spark, sf_dir), ir.all_of(ir.gt("p", 400000.0), ir.lt("o_orderkey", 5000))
    index = ZoneIndex(df, "o_orderkey", ZONE, ["o_orderkey", "p"], scratch_path(spark, "zones"))
    return pruned_scan(df, index, p, row_filter(p, df.schema)).select("o_orderkey", "p")


QUERIES["zone_scan"] = _zone_scan
ORACLE_SQL["zone_scan"] = f"SELECT o_orderkey, p FROM (SELECT *, {NULLABLE} AS p FROM orders) AS t WHERE p > 400000 AND o_orderkey < 5000"


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of months, days and nanoseconds: zones of one value are decided, others are not."""
    zone = zone_of("o_orderkey", ZONE)
    parts = F.struct(F.pmod(zone, F.lit(3)).alias("months"), F.when(zone % 5 == 0, F.col("o_orderkey") % 2).otherwise(F.lit(0)).cast("long").alias("days"), F.lit(0).cast("long").alias("nanos"))
    df = orders(spark, sf_dir).select("o_orderkey", parts.alias("i"))
    return decide(df, "o_orderkey", ZONE, ir.all_of(ir.ge("i", (1, 0, 0)), ir.ne("i", (2, 0, 0))), kinds={"i": T.CalendarIntervalType()})


QUERIES["rg_interval_point"] = _interval
ORACLE_SQL["rg_interval_point"] = f"""WITH z AS (SELECT CAST(floor(o_orderkey / {ZONE}) AS BIGINT) AS zone, count(DISTINCT o_orderkey % 2) AS d FROM orders GROUP BY 1),
t AS (SELECT zone, CASE WHEN zone % 5 = 0 AND d > 1 THEN NULL ELSE zone % 3 >= 1 AND zone % 3 <> 2 END AS tri FROM z) SELECT zone, tri, coalesce(tri, TRUE) AS keep FROM t"""


def _footer_scan(name: str, table: str, columns: tuple[str, ...], predicate: Predicate | str, where: str, **options: bool) -> None:
    QUERIES[name] = lambda spark, sf_dir: PruneRequest(spark, f"{sf_dir}/{table}.parquet").where(predicate).project(*columns).option(**options).prune().scan()
    ORACLE_SQL[name] = f"SELECT {', '.join(sorted(columns))} FROM {table} WHERE {where}"


_footer_scan("pruned_scan", "orders", ("o_orderkey", "o_totalprice"), "o_totalprice > 400000 AND o_orderkey < 5000", "o_totalprice > 400000 AND o_orderkey < 5000")
_footer_scan("footer_scan_between", "orders", ("o_orderkey", "o_totalprice"), ir.between("o_orderkey", 1000, 1200), "o_orderkey BETWEEN 1000 AND 1200")
_footer_scan("footer_scan_text", "lineitem", ("l_orderkey", "l_linenumber"), "l_orderkey < 500 AND l_quantity >= 40", "l_orderkey < 500 AND l_quantity >= 40")
_footer_scan("footer_scan_timestamp", "orders", ("o_orderkey",), ir.lt("o_orderdate", dt.datetime(1995, 2, 1)), "o_orderdate < TIMESTAMP '1995-02-01'")
_footer_scan("footer_scan_truncated", "customer", ("c_custkey",), ir.starts_with("c_mktsegment", "B"), "c_mktsegment LIKE 'B%'", truncated=True)
_footer_scan("footer_scan_bloom", "customer", ("c_custkey", "c_mktsegment"), ir.in_list("c_custkey", [7, 70, 99999999]), "c_custkey IN (7, 70, 99999999)")
_footer_scan("footer_scan_not", "orders", ("o_orderkey",), ir.negate(ir.any_of(ir.gt("o_orderkey", 900), ir.is_null("o_orderkey"))), "NOT (o_orderkey > 900 OR o_orderkey IS NULL)")


def _footer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns: list[tuple[str, T.DataType]] = [("o_orderkey", T.LongType()), ("o_totalprice", T.DoubleType())]
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    made = row_groups(list_files(spark, f"{sf_dir}/orders.parquet"), [(c, schema[c].dataType) for c, _ in columns], pages=False)
    return made.agg(F.sum("num_rows").alias("n"), *[x for i, (c, kind) in enumerate(columns) for x in (F.min(f"low_{i}").cast(kind).alias(f"low_{c}"), F.max(f"high_{i}").cast(kind).alias(f"high_{c}"), F.sum(f"nulls_{i}").alias(f"nulls_{c}"))])


QUERIES["footer_stats"] = _footer_stats
ORACLE_SQL["footer_stats"] = "SELECT count(*) AS n, " + ", ".join(f"min({c}) AS low_{c}, max({c}) AS high_{c}, count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}" for c in ("o_orderkey", "o_totalprice")) + " FROM orders"


def _bitmap_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 10 < 4").select(F.lit("orders").alias("file"), F.col("o_orderkey").cast("long").alias("row_id"))
    return selection.runs_of_ids(selection.ids_of_bitmaps(selection.bitmaps(ids.distinct()))).select("start", "n")


QUERIES["bitmap_round_trip"] = _bitmap_round_trip
ORACLE_SQL["bitmap_round_trip"] = """WITH i AS (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS k FROM orders WHERE o_orderkey % 10 < 4)
SELECT min(k) AS start, count(*) AS n FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM i) AS t GROUP BY island"""


#: What the files for kept_* hold: rows sorted by key within three files (by key % 3), GROUP rows in a row group, PAGE_ROWS in a page.
GROUP, PAGE_ROWS = 400, 100
COPY = "o_orderkey AS k, o_orderkey * 7919 % 1000003 AS h, CASE WHEN o_orderkey % 4000 < 1300 THEN NULL ELSE o_totalprice END AS p, substr('abcdefghijklmnopqrst', CAST(floor(o_orderkey / 3000) % 20 + 1 AS INT), 1) || o_orderpriority AS s, o_orderdate AS t, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS DECIMAL(12,2)) AS d, CAST(o_orderkey AS INT) AS small, o_orderkey % 3 AS part"
BLOOM = {f"parquet.bloom.filter.{name}#h": value for name, value in (("enabled", "true"), ("expected.ndv", "4000"), ("fpp", "0.00001"))}


def orders_copy(spark: SparkSession, sf_dir: str) -> str:
    """A folder with three files of many row groups, as a pipeline that sorts by key would leave them."""
    path = scratch_path(spark, "orders")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_split(COPY))
    sorted_rows = rows.repartition(3, "part").sortWithinPartitions("part", "k")
    sorted_rows.write.options(**BLOOM).option("parquet.block.row.count.limit", str(GROUP)).option("parquet.page.row.count.limit", str(PAGE_ROWS)).option("parquet.enable.dictionary", "false").partitionBy("part").parquet(path)
    return path


def _kept(spark: SparkSession, sf_dir: str, predicate: Predicate | str | None, evidence: Evidence | None = None, **options: bool) -> DataFrame:
    request = PruneRequest(spark, orders_copy(spark, sf_dir), evidence=evidence).option(**options)
    made = (request if predicate is None else request.where(predicate)).prune()
    return shown(made)


def shown(made: PruneResult) -> DataFrame:
    selected = F.coalesce(F.aggregate("ranges", F.lit(0).cast("long"), lambda t, r: t + r["n"]), "num_rows")
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long")
    return made.groups.select(part.alias("part"), F.col("rg").cast("long").alias("rg"), "num_rows", selected.alias("selected"))


def _split(columns: str) -> list[str]:
    """Columns at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _kept_query(name: str, predicate: Predicate | str | None, group: str, page: str = "TRUE", **options: bool | Evidence) -> None:
    """group and page: the conditions in SQL, on low_c, high_c, nulls_c and n, for a row group and a page to be kept."""
    QUERIES[f"kept_{name}"] = lambda spark, sf_dir: _kept(spark, sf_dir, predicate, **options)
    stats = "".join(f", min({c}) AS low_{c}, max({c}) AS high_{c}, count(*) - count({c}) AS nulls_{c}, list({c}) AS all_{c}" for c in ("k", "h", "p", "s", "t", "day", "d", "small"))
    ORACLE_SQL[f"kept_{name}"] = f"""WITH c AS (SELECT {COPY} FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k) - 1 AS i FROM c),
g AS (SELECT part, CAST(floor(i / {GROUP}) AS BIGINT) AS rg, count(*) AS n{stats} FROM r GROUP BY 1, 2),
w AS (SELECT part, CAST(floor(i / {GROUP}) AS BIGINT) AS rg, floor(i % {GROUP} / {PAGE_ROWS}) AS pg, count(*) AS n{stats} FROM r GROUP BY 1, 2, 3),
q AS (SELECT part, rg, sum(n) AS selected FROM w WHERE {page} GROUP BY 1, 2)
SELECT CAST(g.part AS BIGINT) AS part, g.rg, g.n AS num_rows, CAST(selected AS BIGINT) AS selected FROM g JOIN q USING (part, rg) WHERE {group}"""


def _both(name: str, predicate: Predicate | str, condition: str, **options: bool | Evidence) -> None:
    _kept_query(name, predicate, condition, condition, **options)


_both("eq", ir.eq("k", 3500), "low_k <= 3500 AND high_k >= 3500")
_both("ne", ir.ne("k", 3500), "NOT (low_k = 3500 AND high_k = 3500)")
_both("lt", "k < 3500", "low_k < 3500")
_both("ge", "k >= 9000", "high_k >= 9000")
_both("between", "k BETWEEN 3000 AND 3100", "low_k <= 3100 AND high_k >= 3000")
_both("in", "k IN (100, 5000, 8001)", "(low_k <= 100 AND high_k >= 100) OR (low_k <= 5000 AND high_k >= 5000) OR (low_k <= 8001 AND high_k >= 8001)")
_both("and", ir.all_of(ir.gt("k", 2000), ir.lt("k", 2500), ir.TRUE), "high_k > 2000 AND low_k < 2500")
_both("or", "k < 500 OR k > 9500", "low_k < 500 OR high_k > 9500")
_both("is_null", "p IS NULL", "nulls_p > 0")
_both("is_not_null", "p IS NOT NULL", "nulls_p < n")
_kept_query("no_page_index", "k < 3500", "low_k < 3500", page_index=False)
_kept_query("prefix_not_exact", ir.starts_with("s", "c"), "TRUE")  # these files don't say that bounds of strings are whole
_both("prefix", ir.starts_with("s", "c"), "low_s < 'd' AND high_s >= 'c'", truncated=True)
_both("string_eq", ir.eq("s", "c3-MEDIUM"), "low_s <= 'c3-MEDIUM' AND high_s >= 'c3-MEDIUM'", truncated=True)
_kept_query("bloom_eq", ir.eq("h", 7919 * 1501 % 1000003), "list_contains(all_h, 7919 * 1501 % 1000003)", "low_h <= 7919 * 1501 % 1000003 AND high_h >= 7919 * 1501 % 1000003")
_kept_query("bloom_in", ir.in_list("h", [7919 * 33 % 1000003, 7919 * 12001 % 1000003]), "list_has_any(all_h, [7919 * 33 % 1000003, 7919 * 12001 % 1000003])", "(low_h <= 7919 * 33 % 1000003 AND high_h >= 7919 * 33 % 1000003) OR (low_h <= 7919 * 12001 % 1000003 AND high_h >= 7919 * 12001 % 1000003)")
_kept_query("bloom_off", ir.eq("h", 7919 * 1501 % 1000003), "low_h <= 7919 * 1501 % 1000003 AND high_h >= 7919 * 1501 % 1000003", "low_h <= 7919 * 1501 % 1000003 AND high_h >= 7919 * 1501 % 1000003", bloom=False)
_kept_query("bloom_negated", ir.negate(ir.eq("h", 7919 * 1501 % 1000003)), "TRUE")  # a filter can't tell that all rows have a value
_kept_query("nothing", ir.eq("k", -5), "FALSE")
_kept_query("no_predicate", None, "TRUE")
_both("timestamp", ir.ge("t", dt.datetime(2001, 7, 25)), "high_t >= TIMESTAMP '2001-07-25'")
_both("date", "day > DATE '2001-07-25'", "high_day > DATE '2001-07-25'")
_both("decimal", ir.lt("d", decimal.Decimal("500.50")), "low_d < 500.50")
_both("int", "small BETWEEN 700 AND 900", "low_small <= 900 AND high_small >= 700")
_both("double", ir.gt("p", 499900.0), "coalesce(high_p > 499900, TRUE)")  # without bounds a group is unknown
_both("not", ir.negate(ir.gt("k", 1000)), "low_k <= 1000")
_both("flipped_text", "1000 >= k AND NOT (k < 100)", "low_k <= 1000 AND high_k >= 100")
_kept_query("or_all_or_nothing", ir.any_of(ir.lt("k", 500), ir.starts_with("x.y", "a")), "TRUE")  # one side has no statistics
_kept_query("dictionary_eq", ir.eq("s", "c3-MEDIUM"), "list_contains(all_s, 'c3-MEDIUM')", dictionary=True, evidence=ScannedEvidence())
_kept_query("dictionary_in", ir.in_list("s", ["c3-MEDIUM", "d1-URGENT", "zz"]), "list_has_any(all_s, ['c3-MEDIUM', 'd1-URGENT'])", dictionary=True, evidence=ScannedEvidence())
_kept_query("dictionary_unknown", ir.eq("s", "c3-MEDIUM"), "TRUE", dictionary=True, evidence=Evidence())
_kept_query("dictionary_negated", ir.negate(ir.eq("s", "c3-MEDIUM")), "TRUE", dictionary=True, evidence=ScannedEvidence())


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries from a cache that the first of two requests fills; one compiled predicate for both."""
    path = orders_copy(spark, sf_dir)
    cache = CachedEvidence(ScannedEvidence(), scratch_path(spark, "dictionaries"))
    pruner = Pruner(spark, spark.read.parquet(path).schema, PruneOptions(dictionary=True), cache).try_compile("s = 'c3-MEDIUM'")
    pruner.prune(path).groups.count()
    cache.inner = Evidence()  # what isn't cached by now stays unknown
    return shown(pruner.prune(path))


QUERIES["kept_dictionary_cached"], ORACLE_SQL["kept_dictionary_cached"] = _cached, ORACLE_SQL["kept_dictionary_eq"]


def _values(name: str, columns: str, rows: list[tuple], run: Callable[[SparkSession, str], DataFrame]) -> None:
    """A query whose rows are stated here."""
    QUERIES[name] = run
    ORACLE_SQL[name] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows) + f") AS v({columns})"


SHOWN = (
    (ir.all_of(ir.cmp("a", "<=", 5), ir.negate(ir.in_list("b", ["x"])), ir.between("c", 1, 2), ir.any_of()), "(a <= 5 AND NOT (b IN ('x')) AND c BETWEEN 1 AND 2 AND FALSE)", "a,b,c"),
    (ir.any_of(ir.starts_with("s", "ab"), ir.is_null("t"), ir.is_not_null("u")), "(s LIKE 'ab%' OR t IS NULL OR u IS NOT NULL)", "s,t,u"),
    (ir.cmp("a", Op.LT.flip(), 7), "a > 7", "a"),
    (ir.all_of(), "TRUE", ""),
    (with_hints(ir.eq("a", 1), {"a"}, ()), "(a = 1 AND <bloom filter>)", "a"),
    (with_hints(ir.negate(ir.eq("a", "x")), {"a"}, {"a"}), "NOT (a = 'x')", "a"),
    (with_hints(ir.in_list("a", ["x", None]), {"a"}, {"a"}), "a IN ('x', None)", "a"),
)
_values("ir_text", "shown, columns", [r[1:] for r in SHOWN], lambda spark, sf_dir: spark.createDataFrame([(str(p), ",".join(ir.from_json(p.to_json()).columns())) for p, *_ in SHOWN], "shown string, columns string"))

REQUIRED = (("o_orderkey < 5 AND o_totalprice > 1", ["o_custkey"], "o_custkey,o_orderkey,o_totalprice"), ("o_orderkey < 5", ["o_orderkey", "", "o_orderkey"], "o_orderkey"), ("o_orderkey < 5", [], ""), ("length(o_orderstatus) = 1", ["o_custkey"], "o_custkey,o_orderstatus"))


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be read for an output and a condition; nothing named means all."""
    made = [(text, ",".join(output), PruneRequest(spark, f"{sf_dir}/orders.parquet").where(text).project(*output).prune().required_columns) for text, output, _ in REQUIRED]
    return spark.createDataFrame([(t, o, ",".join(c)) for t, o, c in made], "condition string, output string, required string")


_values("projection_of_conditions", "condition, output, required", [(t, ",".join(o), r) for t, o, r in REQUIRED], _required)


def _kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids from the bitmaps of what is kept, counted within the kept row groups of a file."""
    made = PruneRequest(spark, orders_copy(spark, sf_dir)).where("k BETWEEN 3000 AND 3100 OR k > 9900").prune()
    ids = selection.ids_of_bitmaps(made.bitmaps().where("note is null").drop("note"))
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long")
    return ids.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("row_id").alias("least"), F.sum("row_id").alias("total"))


QUERIES["kept_bitmaps"] = _kept_rows
ORACLE_SQL["kept_bitmaps"] = f"""WITH c AS (SELECT {COPY} FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k) - 1 AS i FROM c),
s AS (SELECT *, floor(i / {GROUP}) AS rg, floor(i / {PAGE_ROWS}) AS pg FROM r),
b AS (SELECT *, min(k) OVER (PARTITION BY part, rg) AS gl, max(k) OVER (PARTITION BY part, rg) AS gh, min(k) OVER (PARTITION BY part, pg) AS pl, max(k) OVER (PARTITION BY part, pg) AS ph FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k) - 1 AS id FROM b WHERE (gl <= 3100 AND gh >= 3000) OR gh > 9900)
SELECT CAST(part AS BIGINT) AS part, count(*) AS n, CAST(min(id) AS BIGINT) AS least, CAST(sum(id) AS BIGINT) AS total FROM t WHERE (pl <= 3100 AND ph >= 3000) OR ph > 9900 GROUP BY part"""


def _kept_scan(name: str, condition: str, reader: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: PruneRequest(spark, orders_copy(spark, sf_dir)).where(condition).project("k", "p", "s").prune().scan(reader=reader)
    ORACLE_SQL[name] = f"SELECT k, p, s FROM (SELECT {COPY} FROM orders) AS t WHERE {condition}"


_kept_scan("kept_scan_files", "k BETWEEN 3000 AND 3100 AND p IS NOT NULL", "files")
_kept_scan("kept_scan_ranges", "k BETWEEN 3000 AND 3100 AND p IS NOT NULL", "ranges")


def _text(name: str, condition: str, sql: str | None = None) -> None:
    """A condition as text on orders; sql: the same for DuckDB where that says it in another way."""
    QUERIES[f"sql_{name}"] = lambda spark, sf_dir: PruneRequest(spark, f"{sf_dir}/orders.parquet").where(condition).project("o_orderkey", "o_orderstatus").prune().scan()
    ORACLE_SQL[f"sql_{name}"] = f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {sql or condition}"


_text("split_conjuncts", "o_orderkey < 2000 AND length(o_orderstatus) = 1 AND o_totalprice > 300000")
_text("and_or", "(o_orderkey < 50 AND o_orderstatus = 'F') OR (o_orderkey > 9950 AND o_orderstatus = 'O')")
_text("boolean_literal", "o_orderkey < 30 AND TRUE")
_text("flipped", "100 > o_orderkey")
_text("literal_that_does_not_fit", "o_orderkey < 20.5")
_text("between", "o_orderkey BETWEEN 10 AND 30")
_text("not_between", "o_orderkey NOT BETWEEN 10 AND 9990")
_text("between_word_in_a_call", "if(o_orderstatus = 'between', TRUE, o_orderkey < 40)", "CASE WHEN o_orderstatus = 'between' THEN TRUE ELSE o_orderkey < 40 END")
_text("in_list", "o_orderkey IN (3, 5, 7)")
_text("not_in_list", "o_orderkey NOT IN (3, 5, 7) AND o_orderkey < 20")
_text("like_prefix", "o_orderpriority LIKE '1-%' AND o_orderkey < 500")
_text("like_exact", "o_orderpriority LIKE '3-MEDIUM' AND o_orderkey < 500")
_text("like_escape", "o_orderpriority LIKE '1-%' ESCAPE '!' AND o_orderkey < 500")
_text("like_inner", "o_orderpriority LIKE '%IGH' AND o_orderkey < 500")
_text("is_null", "o_orderkey IS NOT NULL AND NOT (o_orderstatus IS NULL) AND o_orderkey < 20")
_text("not", "NOT (o_orderkey >= 25)")
_text("cast_column", "CAST(o_orderkey AS BIGINT) < 25")
_text("cast_literal", "o_orderkey < CAST('25' AS BIGINT)")
_text("cast_date", "o_orderdate < CAST('1995-02-01' AS DATE)")
_text("timestamp", "o_orderdate >= TIMESTAMP '2001-07-01 12:00:00'")
_text("qualified_name", "orders.o_orderkey < 25")
_text("column_and_column", "o_orderkey < 3000 AND o_orderkey < o_custkey")

WRONG = (
    ("a < 5 AND nosuch = 1", 1, "ColumnNotFound"),
    ("b = 1", 0, "AmbiguousColumn"),
    ("a < 2.5", 0, "CastFailed"),
    ("s > 8", 0, "CastFailed"),
    ("f = 0.1", 0, "CastFailed"),
    ("a = length(s)", 0, "OperatorUnsupported"),
    ("length(s) = 2", 0, "ColumnExpected"),
    ("a <=> 3 AND a > 1 AND s LIKE '_x'", 1, "UnsupportedExpression,UnsupportedExpression"),
    ("a IN (1, length('x'))", 0, "LiteralExpected"),
    ("CAST(a AS STRING) = '5'", 0, "UnsupportedExpression"),
    ("s LIKE 'a!%' ESCAPE '!'", 0, "UnsupportedExpression"),
    ("a > 1 OR length(s) = 2", 0, "ColumnExpected"),
    ("NOT a IN (1, 2)", 1, ""),
)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of a text compile, and what the errors of the others are."""
    compiler = Compiler(spark, T._parse_datatype_string("struct<a:int,s:string,f:float,x:struct<b:int>,y:struct<b:int>>"))
    made = [(text, compiler.compile(text)) for text, *_ in WRONG]
    return spark.createDataFrame([(text, c.n_predicates, ",".join(type(e).__name__ for e in c.errors)) for text, c in made], "text string, compiled long, errors string")


QUERIES["sql_errors"] = _errors
ORACLE_SQL["sql_errors"] = "SELECT * FROM (VALUES " + ", ".join(f"({sql_value(t)}, CAST({n} AS BIGINT), {sql_value(e)})" for t, n, e in WRONG) + ") AS v(text, compiled, errors)"
