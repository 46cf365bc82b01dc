"""Predicates, decisions, selections and the compiler on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from parqsieve.errors import AmbiguousColumn, CastFailed, ColumnNotFound, OperatorUnsupported, UnsupportedExpression
from parqsieve.functions import bloom
from parqsieve.functions.prefix import successor
from parqsieve.operators import ir, selection
from parqsieve.operators.rows import row_filter
from parqsieve.plans.compiler import Compiler
from parqsieve.plans.zonemap import ZoneIndex, decide, joined, page_rows, pruned_scan
from parqsieve.sources.scratch import scratch, scratch_path, shared_dir


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *range(10)]), rng.choice([None, "a", "ab", "b", "c"])) for k in range(240)]
    return spark.createDataFrame(rows, "k long, a long, s string").cache()


def some_predicate(rng, depth=2):
    if depth and rng.random() < 0.6:
        parts = [some_predicate(rng, depth - 1) for _ in range(rng.randint(1, 3))]
        return rng.choice([ir.all_of(*parts), ir.any_of(*parts), ir.negate(parts[0])])
    value = rng.randint(-1, 10)
    return rng.choice([ir.cmp("a", rng.choice(list(ir.Op)), value), ir.between("a", value, value + 2, rng.random() < 0.5), ir.in_list("a", [value, 3][: rng.randint(0, 2)]), ir.is_null("a"), ir.is_not_null("s"), ir.starts_with("s", rng.choice(["a", "ab", "z"])), ir.lt("k", 10 * value), ir.TRUE, ir.FALSE])


@pytest.fixture(scope="module")
def index(spark, table):
    return ZoneIndex(table, "k", 20, ["k", "a", "s"], scratch_path(spark, "zones"))


@pytest.mark.parametrize("seed", range(12))
def test_no_row_is_lost(table, index, seed):
    p = some_predicate(random.Random(seed), 3)
    hits = row_filter(p, table.schema)
    by_zone = {r.zone: r for r in table.groupBy(F.floor(F.col("k") / 20).alias("zone")).agg(F.count_if(hits).alias("yes"), F.count_if(~hits).alias("no")).collect()}
    for r in decide(table, "k", 20, p).collect():
        assert r.tri is not False or by_zone[r.zone].yes == 0
        assert r.tri is not True or by_zone[r.zone].no == 0
    chosen = {(r.zone, s) for r in page_rows(table, "k", 20, 5, [p]).collect() if p.columns() for s, f in zip(r.starts, r.flags, strict=True) if f}
    if p.columns():
        for r in table.where(hits).collect():
            assert (r.k // 20, r.k % 20 // 5 * 5) in chosen
    for most in (64, 2, 1):
        covered = [z for a, b in index.ranges(p, most) for z in range(a, b + 1)]
        assert len(index.ranges(p, most)) <= most and {r.zone for r in decide(table, "k", 20, p).where("keep").collect()} <= set(covered)
    assert sorted(pruned_scan(table, index, p, hits).collect(), key=str) == sorted(table.where(hits).collect(), key=str)


def test_ir_round_trip_and_text():
    p = ir.all_of(ir.gt("a", 5), ir.negate(ir.in_list("b", ["x", b"y"])), ir.between("c", 1, 2, False), ir.any_of())
    assert ir.from_json(p.to_json()) == p
    assert str(p) == "(a > 5 AND NOT (b IN ('x', b'y')) AND c > 1 AND c < 2 AND FALSE)"
    assert p.columns() == ["a", "b", "c"]
    assert ir.Op.LE.flip() is ir.Op.GE


def test_prefix_successor():
    assert successor("ab") == "ac"
    assert successor("a\U0010ffff") == "b"
    assert successor("퟿") == ""
    assert successor("\U0010ffff") is None


def test_bloom_hashing_is_by_physical_type():
    assert bloom.hash_of(5, "INT32") != bloom.hash_of(5, "INT64")
    assert bloom.hash_of(True, "INT32") is None and bloom.hash_of(None, "INT64") is None
    assert not bloom.in_block(bloom.hash_of(5, "INT64"), bytes(32)) and bloom.in_block(bloom.hash_of(5, "INT64"), b"\xff" * 32)


def test_compiler(spark, table):
    compiler = Compiler(spark, table.schema)
    done = compiler.compile("5 < a AND s LIKE 'ab%' AND length(s) > 2 AND a = k")
    assert done.predicates == [ir.gt("a", 5), ir.starts_with("s", "ab")]
    assert [type(e) for e in done.errors] == [UnsupportedExpression, OperatorUnsupported] or len(done.errors) == 2
    assert done.columns == ["a", "k", "s"]
    assert compiler.compile("a IN (1, 2) OR a IS NULL").predicates == [ir.any_of(ir.in_list("a", [1, 2]), ir.is_null("a"))]
    assert isinstance(compiler.compile("nosuch = 1").errors[0], ColumnNotFound)
    assert isinstance(compiler.compile("a < 5.5").errors[0], CastFailed)
    assert compiler.compile("t.a <> 3").predicates == [ir.ne("a", 3)]
    nested = spark.createDataFrame([], "x struct<b:int>, y struct<b:int>").schema
    assert isinstance(Compiler(spark, nested).compile("b = 1").errors[0], AmbiguousColumn)


def test_selection_round_trip(spark):
    groups = spark.createDataFrame([("f", 0, 10, [(2, 3), (7, 3)]), ("f", 4, 5, [(0, 1)]), ("f", 9, 4, None)], "file string, rg int, num_rows long, ranges array<struct<first:long,n:long>>")
    made = [(r.start, r.n, r.skip) for r in selection.runs(groups).orderBy("start").collect()]
    assert made == [(0, 2, True), (2, 3, False), (5, 2, True), (7, 4, False), (11, 4, True), (15, 4, False)]
    ids = selection.row_ids(selection.runs(groups))
    back = selection.ids_of_bitmaps(selection.bitmaps(ids))
    assert sorted(back.collect()) == sorted(ids.collect())
    assert sorted((r.start, r.n) for r in selection.runs_of_ids(ids).collect()) == [(2, 3), (7, 4), (15, 4)]
    assert selection.fits_bitmap((1 << 32) - 1) and not selection.fits_bitmap(1 << 32)


def test_list_leaves_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 12]), (2, []), (3, None)], "k int, x array<int>")
    assert [r.k for r in df.where(row_filter(ir.gt("x.list.element", 9), df.schema)).collect()] == [1]
    from parqsieve.streaming import filter_stream

    df.write.parquet(str(tmp_path / "in"))
    stream = filter_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ir.ge("k", 2))
    query = stream.writeStream.format("memory").queryName("out_rows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("out_rows").count() == 2


def test_ranges_of_zones_join_at_the_nearest():
    assert joined([(5, 5), (1, 1), (2, 3), (9, 9), (20, 21)], 9) == [(1, 3), (5, 5), (9, 9), (20, 21)]
    assert joined([(1, 3), (5, 5), (9, 9), (20, 21)], 3) == [(1, 5), (9, 9), (20, 21)]
    assert joined([(1, 3), (5, 5), (9, 9), (20, 21)], 1) == [(1, 21)] and joined([], 3) == []


def test_zone_scan_pushes_ranges_down_and_keeps_null_keys(spark, tmp_path):
    spark.range(1000).selectExpr("IF(id % 50 = 0, NULL, id) AS k", "id % 7 AS a").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    zones = ZoneIndex(df, "k", 100, ["k", "a"], scratch_path(spark, "zones"))
    p = ir.any_of(ir.between("k", 200, 250), ir.is_null("k"))
    found = pruned_scan(df, zones, p, row_filter(p, df.schema))
    assert found.count() == 49 + 20 and zones.ranges(ir.between("k", 200, 250)) == [(2, 2)]
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_of_runs_are_those_of_ids(spark):
    runs = spark.createDataFrame([("f", 0, 5, False), ("f", 5, 40_000, True), ("f", 40_005, 70_000, False), ("g", 32_767, 2, False), ("g", 32_769, 100_000, True)], "file string, start long, n long, skip boolean")
    by_ids = selection.bitmaps(selection.row_ids(runs)).collect()
    assert sorted((r.file, r.bucket, bytes(r.bits)) for r in selection.bitmaps_of_runs(runs).collect()) == sorted((r.file, r.bucket, bytes(r.bits)) for r in by_ids)


def test_scratch_is_removed_and_shared(spark):
    with scratch(spark):
        path = scratch_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path)
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        from types import SimpleNamespace

        elsewhere = SimpleNamespace(conf=spark.conf, sparkContext=SimpleNamespace(getConf=spark.sparkContext.getConf, master="spark://host:7077"))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(elsewhere)


def test_intervals_are_decided_at_single_points(spark):
    from pyspark.sql import types as T

    from parqsieve.operators.tristate import Stats, tristate

    part = "struct<months:long,days:long,nanos:long>"
    groups = spark.createDataFrame([((1, 0, 0), (1, 0, 0), 0), ((1, 0, 0), (1, 0, 0), 2), ((1, 0, 0), (2, 0, 0), 0), (None, None, 0)], f"low {part}, high {part}, nulls long")
    stats = lambda _: Stats(T.CalendarIntervalType(), F.col("low"), F.col("high"), F.col("nulls"), F.lit(9))
    want = {"=": [True, None, None, None], "!=": [False, None, None, None], "<": [False, False, None, None], ">=": [True, None, None, None]}
    for op, states in want.items():
        assert [r[0] for r in groups.select(tristate(ir.cmp("i", op, (1, 0, 0)), stats)).collect()] == states
    assert [r[0] for r in groups.select(tristate(ir.in_list("i", [(1, 0, 0), (3, 0, 0)]), stats)).collect()] == [True, None, None, None]
    assert [r[0] for r in groups.select(tristate(ir.eq("i", (2, 0, 0)), stats)).collect()] == [False, False, None, None]
