"""Benchmark decontamination by a broadcast set of hashed n-grams.

The words of a text are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became lower case. A window is n
consecutive words of an item; an item of fewer words, but not none, is one window. The item side is broadcast in blocks
of about ``BLOCK_BYTES`` of text, one at a time, each scanned against all documents; more items make more blocks. A
window of a document is looked up by a 64-bit rolling hash and verified word by word. So the work is documents times blocks, and a
window that several items hold is compared with each of them. Long texts are read in pieces. Null texts have no words; items with a null id
count for hits but aren't named. Each input row gives one row, also where rows repeat.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parqsieve.llm.common import map_rows, pick, read_table, slices, written

WORD, BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
PIECE = 1 << 20
NGRAM = 10
BLOCK_BYTES = 32 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
HITS = "doc_id long, n_words long, items array<string>, runs array<struct<first:long,last:long>>"


class Windows:
    """The windows of one block of items, as arrays: some 20 bytes for each word of the items, and their distinct words."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = NGRAM):
        self.word_ids: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        rows, starts, owners, sizes, begin = [np.empty(0, np.uint32)], defaultdict(list), defaultdict(list), [], 0
        for k, (_, text) in enumerate(items):
            words = WORD.findall((text or "").encode().lower())
            rows.append(np.fromiter((self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in words), np.uint32, len(words)))
            if size := min(n, len(words)):
                starts[size].append(np.arange(begin, begin + len(words) - size + 1, dtype=np.int64))
                owners[size].append(np.full(len(words) - size + 1, k, np.int32))
            begin += len(words)
        self.words = np.concatenate(rows)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in starts:
            start, owner = np.concatenate(starts[size]), np.concatenate(owners[size])
            hashes = self.rolling(self.words, size)[start]
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], start[order], owner[order]

    @staticmethod
    def rolling(ids: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(max(0, len(ids) - size + 1), np.uint64)
        for k in range(size):
            total = total * _STEP + ids[k : len(ids) - size + 1 + k].astype(np.uint64)
        return total

    def ids(self, raw: bytes) -> np.ndarray:
        """The words of a text in lower case by number, 0 for those of no item; of a long text a piece at a time."""
        get, out = self.word_ids.get, []
        for piece in pieces(raw):
            words = WORD.findall(piece)
            out.append(np.fromiter((get(w, 0) for w in words), np.uint32, len(words)))
        return np.concatenate(out) if len(out) != 1 else out[0]

    def scan(self, ids: np.ndarray) -> tuple[set, list[tuple[int, int]]]:
        """Items that occur, and the runs [first, last] of hit words, merged, of a text's words by number."""
        inside = np.concatenate(([0], np.cumsum(ids > 0)))
        items, runs = set(), []
        for size, (hashes, start, owner) in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(inside[size:] - inside[:-size] == size)
            mine = self.rolling(ids, size)[at]
            low, high = (np.searchsorted(hashes, mine, side) for side in ("left", "right"))
            for spot, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                same = (self.words[start[a:b, None] + np.arange(size)] == ids[spot : spot + size]).all(axis=1)
                if same.any():
                    items.update(self.names[k] for k in np.unique(owner[a:b][same]).tolist())
                    runs.append((spot, spot + size - 1))
        return items, merged(runs)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """raw in pieces of about so many bytes, cut where no word is."""
    at = 0
    while len(raw) - at > size:
        end = BREAK.search(raw, at + size)
        if end is None:
            break
        yield raw[at : end.start()]
        at = end.start()
    yield raw[at:] if at else raw


def spots(raw: bytes, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Where the words of these numbers stand in a text in lower case."""
    return {k: m.span() for k, m in enumerate(WORD.finditer(raw)) if k in wanted}


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[Windows]]:
    """The number of blocks, of about block_bytes of text each, and the blocks one at a time on the driver; one that is empty if no item has a word."""
    items = pick(items, item_id="item_id", text="text").where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_bytes))
    parts = (items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count))
    return count, (Windows([(r.item_id, r.text) for r in part.toLocalIterator()], n) for part in parts)


def contamination(docs: DataFrame, items: DataFrame, n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs: doc_id, n_words, items (ids of items with windows in it) and runs of hit word numbers."""
    docs = pick(docs, doc_id="doc_id", text="text")
    count, made = blocks(items, n, block_bytes)
    if count > 1:
        return _joined(docs, made)
    held = docs.sparkSession.sparkContext.broadcast(next(made))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [held.value.ids(lowered(t)) for t in part.column(1).to_pylist()]
            hits = [held.value.scan(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([sorted(x for x in found if x is not None) for found, _ in hits], pa.list_(pa.string())),
                    pa.array([[{"first": a, "last": b} for a, b in runs] for _, runs in hits], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "items", "runs"],
            )

    return docs.mapInArrow(scan, HITS)


def _joined(docs: DataFrame, made: Iterator[Windows]) -> DataFrame:
    """The results of several blocks, brought together by a document's id and text; repeated rows come back as often as they were.

    Each block's results are written before the next block is broadcast, so that one block at a time is in memory."""
    parts = []
    for k, windows in enumerate(made):
        held = docs.sparkSession.sparkContext.broadcast(windows)

        def scan(batches: Iterator[pa.RecordBatch], held=held, k=k) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = held.value.ids(lowered(text))
                    found, runs = held.value.scan(words)
                    key = hashlib.sha256(b"-" if text is None else b"+" + text.encode()).digest()
                    rows.append({"doc_id": doc_id, "key": key, "block": k, "n_words": len(words), "items": sorted(x for x in found if x is not None), "runs": [{"first": a, "last": b} for a, b in runs]})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("block", pa.int32()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]))

        parts.append(written(docs.mapInArrow(scan, HITS.replace("doc_id long", "doc_id long, key binary, block int")), "hits"))
        held.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("doc_id", "key", "block").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("items").alias("items"), F.first("runs").alias("runs"))
    whole = once.groupBy("doc_id", "key").agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [[{"first": x, "last": y} for x, y in merged([(r["first"], r["last"]) for r in row])] for row in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], names=["doc_id", "n_words", "items", "runs"])

    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "items", "runs").mapInArrow(merge, HITS)


def decontaminate(docs: DataFrame, items: DataFrame, n: int = NGRAM, remove: str = "documents", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the documents that hold a window (remove="documents") or without the hit words and what stands between them ("spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    names, place = docs.columns, docs.columns.index("text")
    count, made = blocks(items, n, block_bytes)
    for windows in made:
        held = docs.sparkSession.sparkContext.broadcast(windows)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                kept, texts = [], []
                for text in part.column(place).to_pylist():
                    low = lowered(text)
                    _, runs = held.value.scan(held.value.ids(low))
                    kept.append(not runs)
                    if runs and remove == "spans":
                        raw, place_of = text.encode(), spots(low, {x for run in runs for x in run})
                        cuts = [0, *(x for a, b in runs for x in (place_of[a][0], place_of[b][1])), len(raw)]
                        text = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode()
                    texts.append(text)
                if remove == "documents":
                    yield part.filter(pa.array(kept, pa.bool_()))
                else:
                    yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

        docs = map_rows(docs, clean)
        if count > 1:  # one block at a time is in memory
            docs = written(docs.toDF(*[f"_c{i}" for i in range(len(names))]), "clean").toDF(*names)
            held.destroy()
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r["last"] - r["first"] + 1), F.lit(0)).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS gram FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT k, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
hit AS (SELECT dw.k, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, gram)),
spots AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, i, size FROM hit) AS h, unnest(range(h.i, h.i + h.size)) AS t(p) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item_id FROM hit) AS x GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (k) LEFT JOIN named USING (k)
"""
