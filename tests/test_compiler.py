"""Conditions as text against plain Spark: what compiles must mean the same, and what is pruned must hold no match."""

import datetime as dt
import decimal
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from parqsieve.errors import CastFailed, NegationUnsupported, PredicateError, UnsupportedExpression
from parqsieve.operators import ir
from parqsieve.operators.rows import row_filter
from parqsieve.plans import pruner as plans
from parqsieve.plans.compiler import Compiled, Compiler, fixed_offset
from parqsieve.plans.pruner import PruneRequest

@pytest.fixture(autouse=True)
def always_pruned(monkeypatch):
    """The few files here are pruned as many would be."""
    monkeypatch.setattr(plans, "FEW_FILES", 0)


SCHEMA = "k long, i int, f float, d double, m decimal(10,2), s string, is_between boolean, t timestamp, z timestamp_ntz, day date, v binary, n struct<q:int>, a array<int>"


@pytest.fixture(scope="module", params=["UTC", "America/New_York", "+05:30"])
def table(request, spark, tmp_path_factory):
    """Rows in several files and small row groups, with the session and Python itself in one time zone, or in two different ones."""
    was, zone = spark.conf.get("spark.sql.session.timeZone"), os.environ.get("TZ")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    os.environ["TZ"] = "America/New_York" if request.param != "America/New_York" else "Asia/Tokyo"
    time.tzset()
    rng = random.Random(7)
    maybe = lambda x: None if rng.random() < 0.15 else x
    rows = []
    for k in range(160):
        stamp = dt.datetime(2020, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=k)
        rows.append((
            maybe(rng.choice([k, k, 2**53 + 1, -(2**53) - 1])), maybe(rng.randint(-3, 12)), maybe(rng.choice([0.1, 0.5, 2.0, float("nan"), -1.0])), maybe(rng.choice([0.1, 0.5, 2.0, 1e300, -0.0])),
            maybe(decimal.Decimal(rng.randint(0, 500)) / 100), maybe(rng.choice(["a%", "ab", "a!b", "10", "9", "8.0", "", "between", "a_c"])), maybe(rng.random() < 0.5),
            maybe(stamp), maybe(stamp.replace(tzinfo=None)), maybe(stamp.date()), maybe(rng.choice([b"x", b"yy"])), (rng.randint(0, 5),), [rng.randint(0, 9)],
        ))
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, SCHEMA).coalesce(2).sortWithinPartitions("i", "t").write.mode("overwrite").option("parquet.block.row.count.limit", "20").option("parquet.page.row.count.limit", "5").parquet(path)
    yield path
    spark.conf.set("spark.sql.session.timeZone", was)
    spark.conf.unset("spark.sql.ansi.enabled")
    os.environ.pop("TZ") if zone is None else os.environ.update(TZ=zone)
    time.tzset()


def some_text(rng, depth=2):
    if depth and rng.random() < 0.5:
        a, b = some_text(rng, depth - 1), some_text(rng, depth - 1)
        return rng.choice([f"({a} AND {b})", f"({a} OR {b})", f"NOT ({a})", f"{a} AND {b}" if depth == 2 else f"({a})"])
    numbers = ["3", "2.5", "-1", "2.0", "0.1", "5e-1", "2e0", "9007199254740992", "9007199254740993", "9007199254740992e0", "3000000000", "2.50", "0.100", "CAST(3 AS INT)", "CAST('4' AS INT)", "CAST(0.1 AS FLOAT)", "CAST(2.5 AS DECIMAL(5,1))", "'3'", "'2.5'", "NULL", "300000000.5", "1234567890123.25", "'abc'", "TRUE"]
    times = ["TIMESTAMP '2020-01-03 03:00:00'", "TIMESTAMP '2020-01-03 03:00:00+02:00'", "TIMESTAMP_NTZ '2020-01-03 03:00:00'", "DATE '2020-01-04'", "'2020-01-02'", "'2020-01-02 10:00:00'", "'2020-1-2'", "CAST('2020-01-02 10:00:00' AS TIMESTAMP)", "CAST('2020-01-03' AS DATE)", "TIMESTAMP_LTZ '2020-01-05 00:00:00'", "NULL"]
    strings = ["'ab'", "'a!b'", "''", "8", "'8'", "X'61'", "DATE '2020-01-04'", "2.5", "TRUE", "NULL", "CAST(8 AS STRING)"]
    column, values = rng.choice([*((c, numbers) for c in ("k", "i", "f", "d", "m", "n.q", "CAST(i AS INT)", "CAST(i AS BIGINT)")), *((c, times) for c in ("t", "z", "day")), ("s", strings), ("s", strings)])
    value, other = rng.choice(values), rng.choice(values)
    pattern = rng.choice(["'a!%' ESCAPE '!'", "'a%'", "'a\\\\%'", "'ab'", "'%b'", "'a_c'", "'a!_c' ESCAPE '!'", "''", "'%'", "'a%' ESCAPE '!'"])
    return rng.choice([
        f"{column} {rng.choice(['=', '<>', '<', '<=', '>', '>=', '<=>'])} {value}", f"{value} {rng.choice(['=', '<', '>='])} {column}", f"{column} {rng.choice(['', 'NOT '])}BETWEEN {value} AND {other}", f"{column} {rng.choice(['', 'NOT '])}IN ({value}, {other})",
        f"{column} IS {rng.choice(['', 'NOT '])}NULL", f"s {rng.choice(['', 'NOT '])}LIKE {pattern}", "if(is_between, true, false)", "coalesce(is_between, false, true)", f"if({column} IS NULL, is_between, true)", "between(i, 2, 4)", "TRUE", "FALSE", "is_between", "i = q", "i < k",
        f"{column} + 1 > 2" if values is numbers else "TRUE",
    ])


def test_texts_mean_what_spark_says(spark, table):
    """400 texts: a compiled part gives Spark's own true, false or null for each row."""
    df = spark.read.parquet(table)
    rng, compiler, parts = random.Random(5), Compiler(spark, df.schema), []
    for text in (some_text(rng) for _ in range(400)):
        try:
            df.select(F.expr(text))
        except Exception:  # Spark itself refuses it, or the name is a leaf's
            continue
        done = compiler.compile(text)
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
        kept = iter(done.predicates)
        for part in compiler.conjuncts(tree):
            try:
                compiler.walk(part)
            except PredicateError:
                continue
            parts.append((part.sql(), next(kept)))
    assert len(parts) > 150
    whole = df.select(*[F.expr(text).alias(f"e{i}") for i, (text, _) in enumerate(parts)], *[row_filter(p, df.schema).alias(f"p{i}") for i, (_, p) in enumerate(parts)]).collect()
    for i, (text, p) in enumerate(parts):
        assert [r[f"e{i}"] for r in whole] == [r[f"p{i}"] for r in whole], (text, p)


def test_scans_return_what_spark_does(spark, table):
    df, rng, n = spark.read.parquet(table), random.Random(11), 0
    fixed = ["if(is_between, true, false)", "coalesce(is_between, false, true)", "s LIKE 'a!%' ESCAPE '!'", "f = 0.1", "f <= 0.1", "s > 8", "t < TIMESTAMP '2020-01-03 03:00:00'", "t > TIMESTAMP '2020-01-03 03:00:00'", "k < 2.5", "z >= TIMESTAMP '2020-01-03 03:00:00'", "i > 2 AND length(s) > 1", "T.i > 100 AND i > 3"]
    for text in [*fixed, *(some_text(rng) for _ in range(28))]:
        try:
            want = sorted(map(str, df.where(text).collect()))
        except Exception:
            continue
        n += 1
        for reader in ("files", "ranges") if n % 4 == 0 else ("files",):
            made = PruneRequest(spark, table).where(text).option(truncated=True).prune()
            assert sorted(map(str, made.scan(reader=reader).collect())) == want, (text, reader)
    assert n > 25


def test_aware_and_naive_timestamps_of_predicates(spark, table):
    df, at = spark.read.parquet(table), dt.datetime(2020, 1, 3, 3)
    zone = fixed_offset(spark.conf.get("spark.sql.session.timeZone"))
    aware = at.replace(tzinfo=dt.UTC)
    assert df.where(row_filter(ir.lt("t", aware), df.schema)).count() == df.where("t < TIMESTAMP '2020-01-03 03:00:00Z'").count()
    assert df.where(row_filter(ir.lt("t", at), df.schema)).count() == df.where("t < TIMESTAMP '2020-01-03 03:00:00'").count()
    assert df.where(row_filter(ir.lt("z", at), df.schema)).count() == df.where("z < TIMESTAMP_NTZ '2020-01-03 03:00:00'").count()
    assert PruneRequest(spark, table).where(ir.lt("t", aware)).prune().scan().count() == df.where("t < TIMESTAMP '2020-01-03 03:00:00Z'").count()
    failed = Compiler(spark, df.schema).compile("z < TIMESTAMP '2020-01-03 03:00:00'")
    assert (failed.n_errors == 0) == (zone is not None)


def test_results_count_and_strict_mode(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    done = Compiler(spark, schema).compile("i > 2 AND length(s) > 1 AND s LIKE 'a%' ESCAPE '!'")
    assert (done.n_predicates, done.n_errors, done.n_parts) == (1, 2, 3) and not done.complete and done.sql
    made = Compiled.of(ir.all_of(ir.gt("i", 2), ir.lt("k", 3)), ir.eq("s", "x"))
    assert made.n_predicates == 3 and made.columns == ["i", "k", "s"] and made.complete and made.sql is None
    strict = Compiler(spark, schema, strict=True)
    for text in ("i NOT IN (1)", "i NOT BETWEEN 1 AND 2", "s NOT LIKE 'a%'"):
        assert isinstance(strict.compile(text).errors[0], NegationUnsupported)
    assert not strict.compile("NOT i = 1 AND NOT (i > 2)").errors
    for text, name in (("i <=> 3", "<=>"), ("s RLIKE 'a'", "RLIKE"), ("length(s)", "a function call")):
        error = Compiler(spark, schema).compile(text).errors[0]
        assert isinstance(error, UnsupportedExpression) and name in str(error)
    assert all(isinstance(Compiler(spark, schema).compile(t).errors[0], CastFailed) for t in ("i < 3000000000", "f = 0.1", "s > 8", "m = 0.001", "m < 123456789012.00", "k = 9007199254740992e0", "day = '2020-1-2'", "v = 'x'"))
