"""Files written here, with small row groups and pages, pruned by their own footers."""

import datetime as dt
import decimal
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from parqsieve.errors import UnsupportedExpression
from parqsieve.operators import ir, selection
from parqsieve.operators.hints import with_hints
from parqsieve.operators.ir import Hint
from parqsieve.operators.rows import row_filter
from parqsieve.plans import pruner as plans
from parqsieve.plans.pruner import PruneOptions, Pruner, PruneRequest, projection_of
from parqsieve.sources.evidence import CachedEvidence, Evidence, ScannedEvidence
from parqsieve.sources.footers import FooterCache, decoded, footer, leaves, list_files, open_file, row_groups

N = 4000


@pytest.fixture(autouse=True)
def always_pruned(monkeypatch):
    """The few files here are pruned as many would be."""
    monkeypatch.setattr(plans, "FEW_FILES", 0)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("files")
    for f in range(2):
        keys = list(range(f * N, f * N + N))
        table = pa.table({
            "k": pa.array(keys, pa.int64()),
            "a": pa.array([None if k % 1000 < 300 else rng.randint(0, 9) + k // 500 for k in keys], pa.int32()),
            "s": pa.array([rng.choice([None, "ab", "b", "cé"]) if k < N else "z" for k in keys]),
            "d": pa.array([decimal.Decimal(k) / 100 for k in keys], pa.decimal128(12, 2)),
            "t": pa.array([dt.datetime(2020, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=k) for k in keys], pa.timestamp("us", "UTC")),
            "day": pa.array([dt.date(2020, 1, 1) + dt.timedelta(days=k // 24) for k in keys]),
            "even": pa.array([(k * 7919 % 5000) * 2 + k // 1000 % 2 for k in keys], pa.int64()),
            "x": pa.array([[k, k + 1] if k % 3 else [] for k in keys], pa.list_(pa.int64())),
            "n": pa.array([{"b": k % 50} for k in keys], pa.struct([("b", pa.int32())])),
            "m": pa.array([[("u", k)] for k in keys], pa.map_(pa.string(), pa.int64())),
        })
        pq.write_table(table, path / f"{f}.parquet", row_group_size=1000, write_page_index=True, data_page_size=512, write_batch_size=100, use_dictionary=False)
    return str(path)


@pytest.fixture(scope="module")
def schema(spark, folder):
    return spark.read.parquet(folder).schema


def test_leaves_and_footer(folder):
    with open_file(f"file:{folder}/0.parquet") as file:
        meta = footer(file, file.size())
    known = {x.path: x for x in leaves(meta[2])}
    assert list(known) == ["k", "a", "s", "d", "t", "day", "even", "x.list.element", "n.b", "m.key_value.key", "m.key_value.value"]
    assert known["t"].unit == "us" and known["d"].scale == 2 and meta[3] == N and len(meta[4]) == 4


def predicate(rng, depth=2):
    if depth and rng.random() < 0.55:
        parts = [predicate(rng, depth - 1) for _ in range(rng.randint(1, 3))]
        return rng.choice([ir.all_of(*parts), ir.any_of(*parts), ir.negate(parts[0])])
    k = rng.randint(-10, 2 * N)
    return rng.choice([
        ir.cmp("k", rng.choice(list(ir.Op)), k), ir.cmp("a", rng.choice(list(ir.Op)), rng.randint(0, 20)), ir.between("k", k, k + 700, rng.random() < 0.5), ir.in_list("k", [k, k + 2000]), ir.in_list("a", []),
        ir.is_null("a"), ir.is_not_null("s"), ir.starts_with("s", rng.choice(["a", "z", "c"])), ir.eq("s", rng.choice(["ab", "zz"])), ir.lt("d", decimal.Decimal(k)), ir.ge("t", dt.datetime(2020, 1, 1) + dt.timedelta(hours=k)),
        ir.gt("day", dt.date(2020, 1, 1) + dt.timedelta(days=k // 24)), ir.gt("x.list.element", k), ir.eq("n.b", 7), ir.lt("m.key_value.value", k), ir.TRUE, ir.FALSE,
    ])


@pytest.mark.parametrize("seed", range(10))
def test_scan_returns_what_a_plain_filter_does(spark, folder, schema, seed):
    rng = random.Random(seed)
    p = predicate(rng, 3)
    made = Pruner(spark, schema).prune(folder, p, ["k"])
    want = sorted(r.k for r in spark.read.parquet(folder).where(row_filter(p, schema)).select("k").collect())
    assert sorted(r.k for r in made.scan().collect()) == want


def test_row_groups_and_pages(spark, folder, schema):
    pruner = Pruner(spark, schema)
    kept = pruner.prune(folder, ir.between("k", 1500, 1510))
    (row,) = kept.groups.collect()
    assert row.rg == 1 and sum(r.n for r in row.ranges) < 500 and any(r.first <= 500 < r.first + r.n for r in row.ranges)
    assert [r.n for r in kept.runs().where("not skip").collect()] == [r.n for r in row.ranges]
    assert kept.bitmaps().count() == 1 and kept.too_long().count() == 0
    assert PruneRequest(spark, folder).option(bitmap=False).prune().bitmaps() is None
    assert PruneRequest(spark, folder).prune().row_groups().count() == 8
    assert pruner.prune(folder, ir.gt("t", dt.datetime(2030, 1, 1))).row_groups().count() == 0
    assert pruner.prune(folder, ir.lt("d", decimal.Decimal("10.00"))).row_groups().count() == 1
    off = PruneRequest(spark, folder, schema).where(ir.between("k", 1500, 1510)).option(page_index=False).prune()
    assert [(r.rg, r.ranges) for r in off.groups.collect()] == [(1, None)]


def test_scan_is_spread_over_tasks(spark, folder, schema):
    from pyspark.sql import functions as F

    rows = Pruner(spark, schema).prune(folder, None, ["k"]).scan()
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 2


def test_columns_and_errors(spark, folder, schema):
    made = PruneRequest(spark, folder, schema).where("k < 100 AND length(s) > 1").project("d", "", "d").prune()
    assert [str(p) for p in made.predicates] == ["k < 100"] and isinstance(made.errors[0], UnsupportedExpression | Exception) and made.required_columns == sorted({"d", "k", *made.predicate_columns})
    assert made.scan().count() == 100 - sum(1 for r in spark.read.parquet(folder).where("k < 100 AND (s IS NULL OR length(s) <= 1)").select("k").collect())
    with pytest.raises(ValueError, match="exact condition"):
        PruneRequest(spark, folder, schema).where("element > 5 AND length(b) > 1").prune().scan()
    with pytest.raises(Exception):
        Pruner(spark, schema).try_compile("k < 100 AND length(s) > 1")
    assert Pruner(spark, schema).try_compile("k < 100").prune(folder, ["k"]).scan().count() == 100
    assert projection_of(["b", "", "a", "b"]) == ["a", "b"] and projection_of([""]) is None
    with pytest.raises(ValueError):
        Pruner(spark, type(schema)([]))


def test_dictionaries_and_cache(spark, folder, schema, tmp_path):
    cache = CachedEvidence(ScannedEvidence(), str(tmp_path))
    for _ in range(2):
        made = PruneRequest(spark, folder, schema).where(ir.eq("s", "bb")).option(dictionary=True).with_evidence(cache).prune()
        assert made.groups.count() == 0
    plain = PruneRequest(spark, folder, schema).where(ir.eq("s", "bb")).prune()
    assert plain.groups.count() == 4 and cache.entries(spark) == 4
    cache.clear()
    assert cache.entries(spark) == 0
    unknown = PruneRequest(spark, folder, schema).where(ir.eq("s", "bb")).option(dictionary=True).with_evidence(Evidence()).prune()
    assert unknown.groups.count() == 4


def test_bloom_filters(spark, tmp_path):
    df = spark.range(0, 4000, 1, 1).selectExpr("id * 2 AS e", "CAST(id AS STRING) AS s", "CAST(id * 2 AS INT) AS i", "CAST(id AS DOUBLE) AS f")
    path = str(tmp_path / "bloom")
    writer = df.write
    for c in ("e", "s", "i", "f"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "4000")
    writer.parquet(path)
    for p, kept in ((ir.eq("e", 2002), 1), (ir.eq("e", 2003), 0), (ir.eq("i", 2002), 1), (ir.eq("i", 2005), 0), (ir.in_list("e", [2001, 2007]), 0), (ir.in_list("e", [2001, 2006]), 1), (ir.eq("s", "77"), 1), (ir.eq("s", "77x"), 0), (ir.eq("f", 10.5), 0), (ir.eq("f", 10.0), 1), (ir.negate(ir.eq("e", 2003)), 1)):
        assert PruneRequest(spark, path).where(p).prune().groups.count() == kept, p
        if not kept:
            assert PruneRequest(spark, path).where(p).option(bloom=False).prune().groups.count() == 1, p


def test_hints_stay_out_of_negations():
    p = ir.all_of(ir.eq("a", 1), ir.negate(ir.eq("a", 2)), ir.in_list("s", ["x", None]), ir.negate(ir.negate(ir.eq("s", "y"))))
    made = with_hints(p, {"a", "s"}, {"a", "s"})
    assert made == ir.all_of(
        ir.all_of(ir.eq("a", 1), Hint("bloom", "a", (1,))), ir.negate(ir.eq("a", 2)), ir.in_list("s", ["x", None]),
        ir.negate(ir.negate(ir.all_of(ir.eq("s", "y"), Hint("bloom", "s", ("y",)), Hint("dictionary", "s", ("y",))))),
    )


def test_missing_columns_and_empty_files(spark, tmp_path):
    pq.write_table(pa.table({"k": pa.array([1, 2], pa.int64())}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"k": pa.array([], pa.int64()), "v": pa.array([], pa.string())}), tmp_path / "b.parquet")
    pq.write_table(pa.table({"k": pa.array([3], pa.int64()), "v": ["y"]}), tmp_path / "c.parquet")
    schema = spark.read.schema("k long, v string").parquet(str(tmp_path)).schema
    made = Pruner(spark, schema).prune(str(tmp_path), ir.is_null("v"))
    assert sorted(r.k for r in made.scan().collect()) == [1, 2]
    with open_file(str(tmp_path / "a.parquet")) as file, pytest.raises(ValueError):
        footer(file, file.size() - 1)
    assert decoded(b"\x00", leaves([{5: 1}, {1: 2, 4: b"k", 3: 1}])[0], schema["k"].dataType) is None


def counted(log):
    """An opener that leaves a line in a file for each file that it opens."""

    def opener(path):
        with open(log, "a") as out:
            out.write(path + "\n")
        return open_file(path)

    return opener


def test_footers_are_read_once(spark, folder, schema, tmp_path):
    import shutil

    own, log = tmp_path / "own", tmp_path / "log"
    shutil.copytree(folder, own)
    log.touch()
    pruner = Pruner(spark, schema, opener=counted(str(log)), cache=FooterCache(str(tmp_path / "store")))
    for p, kept in ((ir.lt("k", 1500), 2), (ir.ge("k", 7000), 1), (ir.between("k", 3500, 4500), 2)):
        assert pruner.prune(str(own), p).groups.count() == kept
    assert len(log.read_text().split()) == 2
    pq.write_table(pq.read_table(own / "1.parquet").slice(0, 700), own / "1.parquet", row_group_size=100)
    assert pruner.prune(str(own), ir.between("k", 3950, 4150)).groups.count() == 3
    assert len(log.read_text().split()) == 3 and pruner.prune(str(own), ir.ge("k", 7000)).groups.count() == 0


def test_dictionaries_open_a_file_once_in_a_task(spark, tmp_path):
    """However many row groups it has; and the footers are read once for what is missing and once for the result."""
    own, logs = tmp_path / "own", [tmp_path / "footers", tmp_path / "dictionaries"]
    own.mkdir()
    for f in range(2):
        pq.write_table(pa.table({"s": [s for n in range(100) for s in ("", f"{f}-{n:03}", None, "~")]}), own / f"{f}.parquet", row_group_size=4)
    opened = [counted(str(log)) for log in logs]
    pruner = Pruner(spark, spark.read.parquet(str(own)).schema, PruneOptions(bloom=False, dictionary=True), CachedEvidence(ScannedEvidence(opened[1]), str(tmp_path / "store")), opened[0])
    for p, kept in (("s = '1-042'", [(1, 42)]), ("s IN ('0-007', '1-099', 'x')", [(0, 7), (1, 99)])):
        logs[0].write_text("")
        assert sorted((int(r.file[-9]), r.rg) for r in pruner.prune(str(own), p).groups.select("file", "rg").collect()) == kept
        assert len(logs[1].read_text().split()) <= 2 * spark.sparkContext.defaultParallelism and len(logs[0].read_text().split()) <= 4
    assert pruner.evidence.entries(spark) == 200


def test_dictionaries_of_many_values_come_in_parts(spark, tmp_path):
    path, size = tmp_path / "many.parquet", 9000
    pq.write_table(pa.table({"v": pa.array(range(64 * size), pa.int64())}), path, row_group_size=size)
    groups = row_groups(list_files(spark, str(path)), [])
    found = ScannedEvidence().dictionaries(groups, "v", T.LongType())
    shown = found.selectExpr("rg", "size(values) AS n", "array_min(values) AS low", "array_max(values) AS high").collect()
    assert sorted(map(tuple, shown)) == [(g, size, g * size, g * size + size - 1) for g in range(64)]
    few = ScannedEvidence(most=size - 1).dictionaries(groups, "v", T.LongType())
    assert few.where("values is null").count() == 64 and found.where("values is null").count() == 0
    assert ScannedEvidence().dictionaries(groups, "nosuch", T.LongType()).where("values is null").count() == 64


def test_many_files_are_pruned_before_spark_reads_them(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a b%20c")
    for n in range(6):
        pq.write_table(pa.table({"k": pa.array(range(n * 10, n * 10 + 10), pa.int64())}), spark_path(path, f"p={n % 2}", f"{n}.parquet"))
    rows = PruneRequest(spark, path).where("k BETWEEN 15 AND 22").prune().scan()
    assert sorted((r.k, r.p) for r in rows.collect()) == [(k, k // 10 % 2) for k in range(15, 23)]
    assert files_read(rows)["numOutputRows"] == 20  # two of six files
    monkeypatch.setattr(plans, "FEW_FILES", 6)
    assert files_read(PruneRequest(spark, path).where("k BETWEEN 15 AND 22 OR p = 9").prune().scan())["numOutputRows"] > 20
    assert PruneRequest(spark, path).where("k < 0").prune().scan().count() == 0 and PruneRequest(spark, path).where("k >= 0").prune().scan().count() == 60


def spark_path(*parts):
    import os

    os.makedirs(os.path.join(*parts[:-1]), exist_ok=True)
    return os.path.join(*parts)


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, out = plan.collectLeaves(), {}
    for i in range(leaves.size()):
        each = leaves.apply(i).metrics().iterator()
        while each.hasNext():
            pair = each.next()
            out[pair._1()] = pair._2().value()
    return out


def test_parts_totals_and_notes(spark, folder, schema, monkeypatch):
    made = Pruner(spark, schema).prune(folder, ir.between("k", 1500, 1510), ["d"])
    groups, runs, bitmaps = made.parts()
    assert groups.count() == 1 and runs.count() >= 2 and bitmaps.where("note is null").count() == 1
    assert made.parts_with_projection()[3] == ["d", "k"]
    total = made.totals()
    assert (total["files"], total["groups"]) == (1, 1) and 11 <= total["rows"] < 500
    monkeypatch.setattr(selection, "MOST_ROWS", 999)
    (row,) = made.bitmaps().collect()
    assert row.bits is None and "no bitmap" in row.note and made.too_long().count() == 1
