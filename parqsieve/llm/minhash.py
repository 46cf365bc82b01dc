"""MinHash near-duplicates with tensored banding.

A document's set holds the hashes of its distinct ``WORDS``-word shingles; with fewer words the whole sequence is its one
shingle. ``SIDE`` entries of either of two small collections, each of ``DEPTH`` minhashes, are combined in pairs: SIDE * SIDE
table keys of 2 * DEPTH minhashes each from 2 * SIDE * DEPTH instead of SIDE * SIDE * 2 * DEPTH of them. A pair of similarity
s is missed by all tables with a probability of about 2 * (1 - s**DEPTH)**SIDE, 1e-4 at 0.75 and less beyond.

Steps: equal sets (of one size, with two equal 64-bit sums of differently mixed hashes) become one class, aggregated before
the shuffle. Each task drops its own repeats of a table key, so a key reaches its place at most once for each batch that has
it. Classes that share keys make families (connected components, in tables); that only says where texts have to meet. Two
classes are candidates if they agree in an entry of either collection, which is what sharing a table key means; only
candidates are verified, on full sets, and only if no chain of links has connected them by then.

A family of one block (``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles at most) meets in one task. A larger one is dealt
out twice. First every block meets ``PIVOTS`` classes of the family: in a group of copies nearly all link to one of these, so
each text is read once however large the group. Then the stragglers, the classes outside the family's largest component,
are dealt out in blocks of their own, and each of these meets every block of the family. So the work is a family's size
times its number of blocks of stragglers, and no task holds more than two blocks. Links leave a task as a forest, and
components of all forests are the result.

Null ids and texts without words are linked with nothing; so component_id is the own id, null for a null id, and kept is
true. Rows of equal ids are one node with all their texts, and each has its own n_shingles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parqsieve.llm.common import join_hot, pick, read_table, shuffle_partitions, slices, written
from parqsieve.llm.components import Sets, components

WORDS = 5
SIDE = 12
DEPTH = 2
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
PIVOTS = 16
KEYS_A_PLACE = 2_000_000
PERCENT = 75
WORD_CACHE = 150_000
_seeds = np.random.default_rng(20240601)
STEPS = _seeds.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
FUNCTIONS = _seeds.integers(1, 1 << 63, (2 * SIDE * DEPTH, 1), dtype=np.uint64) | np.uint64(1)
SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, u array<long>, v array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are parted by blank and \\x09-\\x0d, which is what bytes.split parts by."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    sums = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        sums += mixed(h[i : len(h) - size + 1 + i] * STEPS[i])
    return np.unique(mixed(sums))


def total(s: np.ndarray) -> int:
    return int(s.sum(dtype=np.uint64).view(np.int64))


def minhashes(s: np.ndarray) -> np.ndarray:
    """The 2 * SIDE entries of the two collections."""
    least = np.full(len(FUNCTIONS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        least = np.minimum(least, (s[None, at : at + 2048] * FUNCTIONS).min(axis=1))
    entry = np.zeros(2 * SIDE, np.uint64)
    for d in range(DEPTH):
        entry = mixed(entry + least[d :: DEPTH])
    return entry


def signatures(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            n, h1, h2, u, v = [], [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text, hashes)
                n.append(len(s))
                entry = minhashes(s).view(np.int64) if len(s) else None
                h1.append(total(s))
                h2.append(total(mixed(s ^ np.uint64(0x5851F42D4C957F2D))))
                u.append(None if entry is None else entry[:SIDE])
                v.append(None if entry is None else entry[SIDE:])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(u, longs), pa.array(v, longs)], names=["doc_id", "n_shingles", "h1", "h2", "u", "v"])

    return docs.mapInArrow(sign, SIGNATURE)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges with the same components."""
    if not len(a):
        return a, b
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs = np.unique(at.reshape(2, -1).T, axis=0)
    sets = Sets(len(names))
    used = [sets.join(x, y) for x, y in pairs.tolist()]
    pairs = pairs[np.array(used, bool)]
    return names[pairs[:, 0]], names[pairs[:, 1]]


def shared_keys(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys once each, their smallest ids, and edges from that id to the others of the key)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    center = ids[first][np.cumsum(first) - 1] if len(keys) else ids
    other = ~first & (center != ids)
    return keys[first], ids[first], center[other], ids[other]


def candidate_edges(classes: DataFrame, n_classes: int) -> DataFrame:
    """a, b: forests over the classes (rep, u, v) that share a table key."""
    places = max(shuffle_partitions(classes.sparkSession), math.ceil(n_classes * SIDE * SIDE / KEYS_A_PLACE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(SIDE * SIDE, dtype=np.uint64).reshape(1, SIDE, SIDE)
        for b in slices(batches, 8192):
            rep = b.column(0).to_numpy()
            u, v = (np.asarray(b.column(i).flatten()).view(np.uint64).reshape(-1, SIDE) for i in (1, 2))
            keys = mixed(u[:, :, None] + mixed(v[:, None, :] + number))
            keys, ids, x, y = shared_keys(keys.ravel(), np.repeat(rep, SIDE * SIDE))
            x, y = forest(x, y)
            cuts = np.searchsorted(keys, (np.arange(places + 1, dtype=object) * (1 << 64) // places)[:-1].astype(np.uint64))
            cuts = [*cuts.tolist(), len(keys)]
            rows = [{"place": p, "keys": keys[s:e].tobytes(), "ids": ids[s:e].tobytes(), "x": x.tobytes() if p == 0 else b"", "y": y.tobytes() if p == 0 else b""} for p, (s, e) in enumerate(itertools.pairwise(cuts)) if e > s or p == 0]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("place", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "x", "y"))]))

    def meet(table: pa.Table) -> pa.Table:
        whole = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        _, _, x, y = shared_keys(whole("keys", np.uint64), whole("ids", np.int64))
        x, y = forest(np.concatenate([x, whole("x", np.int64)]), np.concatenate([y, whole("y", np.int64)]))
        return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return classes.select("rep", "u", "v").mapInArrow(deal, "place int, keys binary, ids binary, x binary, y binary").groupBy("place").applyInArrow(meet, "a long, b long")


class Members:
    """Classes that meet in one task: ids, entries of both collections, sets."""

    def __init__(self, rows: list[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.asking = np.array([r[1] for r in rows], bool)
        self.u, self.v = (np.stack([r[k] for r in rows]) for k in (2, 3))
        self.sizes = np.array([len(r[4]) for r in rows])
        names, flat = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
        self.flat, self.n_names = flat.astype(np.int32), len(names)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def links(self, percent: int = PERCENT) -> list[tuple[int, int]]:
        """A forest of the links between asking members and any others; candidates not yet connected are confirmed, best-connected sets first."""
        times = np.bincount(self.flat, minlength=self.n_names)
        order = np.argsort(-np.add.reduceat(times[self.flat], self.starts) / self.sizes, kind="stable")
        mark, group, out = np.zeros(self.n_names, bool), np.arange(len(self.ids)), []
        for c in order[self.asking[order]].tolist():
            n = self.sizes[c]
            at = np.flatnonzero((group != group[c]) & (100 * np.minimum(self.sizes, n) >= percent * np.maximum(self.sizes, n)))
            at = at[(self.u[at] == self.u[c]).any(axis=1) & (self.v[at] == self.v[c]).any(axis=1)]
            if not len(at):
                continue
            mine = self.flat[self.starts[c] : self.starts[c] + n]
            mark[mine] = True
            reach = np.cumsum(self.sizes[at])
            spots = np.arange(reach[-1]) + np.repeat(self.starts[at] - reach + self.sizes[at], self.sizes[at])
            common = np.add.reduceat(mark[self.flat[spots]], reach - self.sizes[at], dtype=np.int64)
            mark[mine] = False
            for x in at[100 * common >= percent * (self.sizes[at] + n - common)].tolist():
                if group[x] != group[c]:
                    group[group == group[x]] = group[c]
                    out.append((int(self.ids[c]), int(self.ids[x])))
        return out


def tasks_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of sorted batches, by their first n_keys columns; each group is to be read before the next."""
    rows = (row for part in slices(batches, 64) for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[:n_keys]):
        yield key, (r[n_keys:] for r in group)


GROUPED = ("component", "i", "j", "doc_id", "asking", "h1", "u", "v", "text")


def confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: forests of the links within each group (component, i, j) of GROUPED rows, of which at least one end is asking."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, rows in tasks_of(batches, 3):
            unique: dict[tuple, list] = {}
            for doc_id, asking, h1, u, v, text in rows:  # of each text only its set is kept
                s = shingles(text, hashes)
                if len(s) and total(s) == h1:  # an id may have several texts
                    held = unique.setdefault((doc_id, hash(s.tobytes())), [doc_id, False, np.array(u), np.array(v), s])
                    held[1] |= asking
            found = Members(list(unique.values())).links(percent) if len(unique) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    shuffled = rows.select(*GROUPED).repartition(shuffle_partitions(rows.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return shuffled.mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    docs = pick(docs, doc_id="doc_id", text="text")
    signed = written(signatures(docs), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("u").alias("u"), F.first("v").alias("v")), "classes")
    found = components(written(candidate_edges(classes, classes.count()), "candidates"), "families")
    members = written(found.join(classes.select(F.col("rep").alias("node"), "n_shingles", "h1", "u", "v"), "node").select("component", F.col("node").alias("doc_id"), "n_shingles", "h1", "u", "v"), "families")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = join_hot(members, sizes, ["component"], "n", members.count()).withColumn("i", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).select("component", "blocks", "i", "doc_id", "h1", "u", "v")
    pivots = dealt.where("blocks > 1").groupBy("component", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PIVOTS))).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct().withColumn("pivot", F.lit(True))
    dealt = written(dealt.join(pivots, "doc_id", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False))), "family-blocks")
    # by shuffle at every size: members grow with the corpus, so the plan mustn't turn on whether they happen to be few
    texts = written(docs.join(dealt.hint("shuffle_hash"), "doc_id"), "family-texts").withColumns({"j": F.lit(0), "asking": F.lit(True)})
    links = confirmed(texts.where("blocks = 1"), percent)
    if not dealt.where("blocks > 1").isEmpty():
        large = dealt.where("blocks > 1")
        every = texts.where("blocks > 1")
        to_blocks = every.where("pivot").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        once = written(confirmed(every.withColumn("asking", F.lit(False)).select(*GROUPED).unionByName(to_blocks.select(*GROUPED)), percent), "pivot-links")
        links = links.unionByName(once)
        reached = components(once, "pivot-groups").select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
        parts = large.select("component", "doc_id").distinct().join(reached, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
        largest = parts.groupBy("component", "part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "part")).alias("most")).select("component", F.col("most.part").alias("main"))
        left = written(parts.join(largest, "component").where("part <> main").select("component", "doc_id"), "stragglers")
        if not left.isEmpty():
            left_blocks = left.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("left_blocks"))
            of = F.pmod(F.xxhash64("doc_id", F.lit(1)), "left_blocks").cast("int")
            ids = large.select("component", "doc_id").distinct().join(left_blocks, "component").join(left.select("doc_id", F.lit(True).alias("left")), "doc_id", "left").select("doc_id", "left_blocks", F.when(F.col("left"), of).alias("of"))
            again = written(every.drop("i", "j", "asking").join(ids.hint("shuffle_hash"), "doc_id"), "straggler-texts").withColumn("i", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
            answering = again.withColumns({"j": F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)), "asking": F.lit(False)})
            asking = again.where("of is not null").withColumns({"j": F.col("of"), "i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asking": F.lit(True)})
            links = links.unionByName(confirmed(answering.select(*GROUPED).unionByName(asking.select(*GROUPED)), percent))

    equal = join_hot(some.select("doc_id", "h1", "h2", "n_shingles"), classes.select("h1", "h2", "n_shingles", "rep", "copies"), ["h1", "h2", "n_shingles"], "copies", some.count())
    found = components(links.unionByName(equal.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), "groups")
    joined = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each group. All rows of its id stay, but for repeats of one id and text, and so do rows with a null doc_id."""
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text = (f"_c{names.index(c)}" for c in ("doc_id", "text"))
    keep = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(doc_id)).distinct()
    one = inner.join(keep, doc_id, "left_semi").select(*inner.columns).withColumn("_text", F.sha2(F.col(text).cast("binary"), 256)).dropDuplicates([doc_id, "_text"]).drop("_text")
    return one.unionByName(inner.where(F.col(doc_id).isNull())).toDF(*names)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS gram FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT k, doc_id, count(*) AS n FROM s GROUP BY k, doc_id),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS common FROM s AS a JOIN s AS b USING (gram) WHERE a.k < b.k GROUP BY a.k, b.k),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n AS x ON x.k = p.a JOIN n AS y ON y.k = p.b WHERE 100 * common >= 75 * (x.n + y.n - common) AND x.doc_id <> y.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, component) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(component) AS component FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component AS component_id, d.doc_id IS NOT DISTINCT FROM component AS kept
FROM d LEFT JOIN n USING (k) LEFT JOIN c ON c.node = d.doc_id
"""
