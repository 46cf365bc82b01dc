"""Removal of repeated byte strings: bytes of any LENGTH-byte string that also starts elsewhere in the corpus.

Strings to compare are routed first. The LENGTH-byte string at each position is known by its marker, the least hash of
its MARKER-byte substrings: equal strings have equal markers. Neighbouring positions of one marker form a segment, a row
for about every 70 bytes. Segments go to the place of their marker, packed, after each batch has merged its equal ones:

* a marker that occurs once is done: none of its strings repeats (one that recurs within a segment goes the third way);
* equal segments (two independent 64-bit hashes) repeat in full;
* where different segments share a marker, one segment of each kind goes to be compared. Segments are gathered in shards of
  ``SHARD_BYTES``; a task sorts the suffixes of its shards and sends their Burrows-Wheeler transforms, each split by place (the
  rows of whole segments, in the shard's order, are the transform of these segments alone). In a place the transforms
  are merged: the interleave of their rows, first by one symbol of ``SYMBOL`` bytes, is refined symbol by symbol (eight rounds for 200 bytes; a symbol of one byte
  would take 200). In each round
  the rows of unfinished intervals take the order in which their successors stand; the rows of one transform never
  change their order, and no suffix is sorted again. Where the successors of two neighbours lie in different intervals, their
  common prefix ends, so the intervals left after LENGTH bytes are those of the common prefixes of at least LENGTH:
  the strings that repeat. Rows alone in their interval leave at once.

A segment has at most ``STRINGS`` strings. Markers with more than ``HOT_KINDS`` different segments are split: the strings of their
segments are routed once more, by a marker of ``LONG_MARKER`` bytes.

Strings are judged on the input, never across documents. Null and empty texts have no bytes. Repeated rows repeat each
other. A null doc_id is a document like any other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.llm.common import pick, read_table, shuffle_partitions, slices, written
from parqsieve.llm.minhash import mixed

LENGTH = 200
MARKER = 64
CHUNK = 1 << 19
PLACE_BYTES = 12 << 20
MERGE_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
SYMBOL = 25
PACKED = 7
STRINGS = 4096
HOT_KINDS = 8192
LONG_MARKER = 128
_random = np.random.default_rng(20240602)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = int(_random.integers(1 << 61, 1 << 62)) * 2 + 1
NEED, WHOLE, LEND, HOT = 2, 1, 3, 4
_powers: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        n = CHUNK + 2 * LENGTH
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out, have = np.ones(n, np.uint64), 1
            while have < n:
                out[have : 2 * have] = out[: min(have, n - have)] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


def segments(data: bytes, ends: np.ndarray, length: int = LENGTH, marker: int = MARKER) -> tuple[np.ndarray, ...]:
    """marker (mixed once more, as least hashes crowd at the low end), segment hash, first string, number of strings, whether the marker occurs in it more than once, of the segments of documents that end at ends."""
    raw = np.frombuffer(data, np.uint8)
    up, down = powers()
    out = []
    for a in range(0, max(0, len(raw) - length + 1), CHUNK):
        part = raw[a : a + CHUNK + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * up[: len(part)], out=sums[1:])
        least = each = mixed((sums[marker:] - sums[:-marker]) * down[: len(part) - marker + 1])
        span, wide = 1, length - marker + 1
        while span * 2 <= wide:
            least = np.minimum(least[span:], least[:-span])
            span *= 2
        if wide > span:
            least = np.minimum(least[wide - span :], least[: span - wide])
        starts = np.arange(a, a + len(least))
        end_of = ends[np.searchsorted(ends, starts, side="right")]
        valid = starts + length <= end_of
        change = np.concatenate(([True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (end_of[1:] != end_of[:-1])))
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(least)))
        first, count = first[valid[first]], count[valid[first]]
        pieces = -(-count // STRINGS)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, count = np.repeat(first, pieces) + piece * STRINGS, np.minimum(STRINGS, np.repeat(count, pieces) - piece * STRINGS)
        whole = (sums[first + count + length - 1] - sums[first]) * down[first]
        reach = count + wide - 1
        base = np.concatenate(([0], np.cumsum(reach)))
        spots = np.arange(base[-1]) + np.repeat(first - base[:-1], reach)
        again = np.add.reduceat(each[spots] == np.repeat(least[first], reach), base[:-1], dtype=np.int64) > 1 if len(first) else np.empty(0, bool)
        out.append((mixed(least[first]), mixed(whole + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first + a, count, again.astype(np.int64)))
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.empty(0, k) for k in kinds)


def slots_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes plus one, each text followed by a zero as its end; where each text begins; and the place of the end for every slot."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.int16)
    inside = np.ones(len(symbols), bool)
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    return symbols, begins, np.repeat((begins + sizes).astype(np.int32), sizes + 1)


def first_symbols(symbols: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """The first PACKED bytes of every suffix as a number, with zeros beyond its end."""

    def joined(front: np.ndarray, n: int, tail: np.ndarray, m: int) -> np.ndarray:
        """n symbols, then m more where the text hasn't ended by then."""
        out = front << 9 * m
        out[: len(out) - n] |= np.where(front[: len(out) - n] & 511, tail[n:], 0)
        return out

    key = np.empty(len(symbols), np.int64)
    for a in range(0, len(symbols), piece):
        one = symbols[a : a + piece + PACKED].astype(np.int64)
        two = joined(one, 1, one, 1)
        key[a : a + piece] = joined(joined(two, 2, two, 2), 4, joined(two, 2, one, 1), 3)[: len(key[a : a + piece])]
    return key


def singles_out(rows: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The rows of intervals of more than one; fresh marks the first of each."""
    return rows[~(fresh & np.append(fresh[1:], True))]


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard: the byte before each suffix in their order, whether the suffix is a whole text (and so has none), and the number of its text.

    The end of a text is less than any byte, and ends go by the number of their text, so the first rows are the ends."""
    symbols, begins, end = slots_of(texts)
    n = len(symbols)
    count = np.arange(n, dtype=np.int32)
    key = first_symbols(symbols)
    key[begins + np.array([len(t) for t in texts])] = np.arange(len(texts)) - len(texts)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if n else np.empty(0, bool)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, count, 0))
    open_, depth = singles_out(order, fresh), PACKED
    while len(open_):
        key = rank[open_].astype(np.int64) << 32 | rank[np.minimum(open_.astype(np.int64) + depth, end[open_])]
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        old, at = (key >> 32).astype(np.int32), count[: len(by)]
        spot = old + at - np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), at, 0))
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[open_] = np.maximum.accumulate(np.where(fresh, spot, 0))
        open_, depth = singles_out(open_, fresh), depth * 2
    order[rank] = count
    owner = np.searchsorted(begins, order, side="right") - 1
    whole = order == begins[owner]
    before = np.where(whole, 0, symbols[order - 1] - 1).astype(np.uint8) if n else np.empty(0, np.uint8)
    return before, whole, owner


def merged_repeats(before: np.ndarray, whole: np.ndarray, shard_rows: np.ndarray, shard_texts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(number of a text, position in it) of all strings of length bytes that start more than once in the texts of several shards.

    before and whole are the shards' transforms one after another, shard_rows and shard_texts their numbers of rows and of texts, sizes those of the texts."""
    n, texts = len(before), len(sizes)
    row_base, text_base = np.cumsum(shard_rows) - shard_rows, np.cumsum(shard_texts) - shard_texts
    end_row = np.arange(texts) + np.repeat(row_base - text_base, shard_texts)  # of the end of each text
    is_end = np.zeros(n, bool)
    is_end[end_row] = True
    # from a row to that of the suffix one byte longer: rows of a shard by their byte, in order, are its rows that aren't ends
    inner = np.flatnonzero(~whole)
    ordered = (np.repeat(np.arange(len(shard_rows)), shard_rows)[inner] << 8 | before[inner]) << 32
    ordered |= inner
    ordered.sort()
    back = np.full(n, -1, np.int32)
    back[ordered & 0xFFFFFFFF] = np.flatnonzero(~is_end)
    del inner, ordered, is_end
    # read the texts backward from their ends, all at once
    begins = np.cumsum(sizes + 1) - sizes - 1
    by_size = np.argsort(-sizes, kind="stable")
    row_at, symbols = np.empty(n, np.int32), np.zeros(n, np.int16)
    rows, reach, falling = end_row[by_size], (begins + sizes)[by_size], -sizes[by_size]
    for step in range(int(sizes.max(initial=-1)) + 1):
        many = int(np.searchsorted(falling, -step, side="right"))
        rows, reach = rows[:many], reach[:many]
        row_at[reach - step] = rows
        live = ~whole[rows]
        symbols[(reach - step - 1)[live]] = before[rows[live]].astype(np.int16) + 1
        rows = np.where(live, back[rows], 0)
    del back
    slot = np.empty(n, np.int32)
    slot[row_at] = np.arange(n, dtype=np.int32)
    end = np.repeat((begins + sizes).astype(np.int32), sizes + 1)
    # the interleave by the first bytes: each shard's rows come sorted, so this only merges them
    first = min(PACKED, length)
    key = first_symbols(symbols)
    key >>= 9 * (PACKED - first)
    key = key[slot]
    at_pos = np.argsort(key, kind="stable").astype(np.int32)
    key, count = key[at_pos], np.arange(n, dtype=np.int32)
    short = (end - count)[slot[at_pos]] < first
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | short[1:] | short[:-1])) if n else np.empty(0, bool)
    del key, end, short, symbols
    pos, interval = np.empty(n, np.int32), np.empty(n, np.int32)
    pos[at_pos] = count
    interval[at_pos] = np.maximum.accumulate(np.where(fresh, count, 0))
    open_, depth = singles_out(at_pos, fresh), first
    while depth < length and len(open_):
        step = min(SYMBOL, depth, length - depth)  # the first symbol itself is put together from PACKED bytes
        ordered = interval[open_].astype(np.int64) << 32 | pos[row_at[slot[open_] + step]]
        ordered.sort()
        old, after = (ordered >> 32).astype(np.int32), at_pos[ordered & 0xFFFFFFFF]
        open_ = row_at[slot[after] - step]
        begun = np.concatenate(([True], old[1:] != old[:-1]))
        at = count[: len(open_)]
        spot = old + at - np.maximum.accumulate(np.where(begun, at, 0))
        parted = interval[after]
        fresh = begun | np.concatenate(([True], parted[1:] != parted[:-1]))
        pos[open_], at_pos[spot] = spot, open_
        interval[open_] = np.maximum.accumulate(np.where(fresh, spot, 0))
        open_, depth = singles_out(open_, fresh), depth + step
    found = np.sort(slot[open_])
    owner = np.searchsorted(begins, found, side="right") - 1
    return owner, found - begins[owner]


def joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


ASK = "key long, id long, begin long, n long, code int, marker long"
ASK_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
ASK_NAMES = ["key", "id", "begin", "n", "code", "marker"]


def keyed(docs: DataFrame) -> DataFrame:
    """key and id of a document: rows that are alike in both are alike in doc_id and text."""
    return pick(docs, doc_id="doc_id", text="text").select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("id"), "text")


def requests(docs: DataFrame, length: int) -> DataFrame:
    """ASK rows: what repeats in full (WHOLE), what has to be compared (NEED), and what is lent to be compared with (LEND)."""
    places = shuffle_partitions(docs.sparkSession)
    # a place should hold few MB of packed segments: about 24 bytes for each 70 of text
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = max(places, int(size * 24 / 70 / PLACE_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("place", pa.int32()), ("packed", pa.binary()), *zip(ASK_NAMES, ASK_KINDS, strict=True)])
        for batch in batches:
            held = []
            for part in slices([batch], 256):
                texts = [(t or "").encode() for t in part.column(2).to_pylist()]
                ends = np.cumsum([len(t) for t in texts])
                ends = np.append(ends, ends[-1])
                found = segments(b"".join(texts), ends, length)
                doc = np.searchsorted(ends[:-1], found[2], side="right")
                begins = np.concatenate(([0], ends[:-1]))[doc]
                held.append((found[0], found[1], part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc], found[2] - begins, found[3], found[4]))
            if not held:
                continue
            mark, whole, key, ids, begin, n, again = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((whole, mark))
            mark, whole, key, ids, begin, n, again = (x[order] for x in (mark, whole, key, ids, begin, n, again))
            first = np.concatenate(([True], (mark[1:] != mark[:-1]) | (whole[1:] != whole[:-1]))) if len(mark) else np.empty(0, bool)
            times = np.diff(np.append(np.flatnonzero(first), len(mark)))
            many = np.repeat(times > 1, times)
            # within the batch: equal segments repeat in full; one of each kind goes on
            for x in range(0, len(mark), 200_000):
                at = x + np.flatnonzero(many[x : x + 200_000])
                if len(at):
                    zero = pa.nulls(len(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1, np.int32)), zero.cast(pa.binary()), pa.array(key[at]), pa.array(ids[at]), pa.array(begin[at]), pa.array(n[at]), pa.array(np.full(len(at), WHOLE, np.int32)), zero.cast(pa.int64())], schema=schema)
            one = np.flatnonzero(first)
            rows = np.stack([mark[one].view(np.int64), whole[one].view(np.int64), key[one], ids[one], begin[one], n[one] << 2 | again[one] << 1 | (times > 1)], axis=1)
            place = ((mark[one] >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
            packed = [(int(place[x]), packing(rows[x:y])) for x, y in itertools.pairwise([*cuts.tolist(), len(place)])]
            if packed:
                nulls = [pa.nulls(len(packed)).cast(t) for t in ASK_KINDS]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary()), *nulls], schema=schema)

    def meet(table: pa.Table) -> pa.Table:
        rows = np.concatenate([unpacking(b) for b in table.column("packed").to_pylist()])
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        new_mark = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
        new_kind = new_mark | np.concatenate(([True], rows[1:, 1] != rows[:-1, 1]))
        kind, mark = np.cumsum(new_kind) - 1, np.cumsum(new_mark) - 1
        many_here = np.bincount(kind)[kind] > 1
        flags = rows[:, 5] & 3
        before = np.bincount(kind, weights=flags & 1)[kind] > 0
        kinds = np.bincount(mark, weights=new_kind)[mark]
        shared = kinds > 1
        code = np.zeros(len(rows), np.int32)
        code[many_here & (flags & 1 == 0)] = WHOLE
        need = (shared | (flags > 1)) & ~many_here & ~before
        code[need] = NEED
        lend = shared & (many_here | before) & new_kind
        hot = np.where(kinds > HOT_KINDS, HOT, 0).astype(np.int32)
        code[need] |= hot[need]
        out = [(rows[code > 0], code[code > 0]), (rows[lend], LEND | hot[lend])]
        rows, code = np.concatenate([x for x, _ in out]), np.concatenate([c for _, c in out])
        return pa.table([pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(rows[:, 4]), pa.array(rows[:, 5] >> 2), pa.array(code), pa.array(rows[:, 0])], names=ASK_NAMES)

    dealt = written(docs.mapInArrow(deal, f"place int, packed binary, {ASK}"), "segments")
    met = dealt.where("place >= 0").select("place", "packed").groupBy("place").applyInArrow(meet, ASK)
    return dealt.where("place < 0").select(*ASK_NAMES).unionByName(met)


def packing(rows: np.ndarray) -> bytes:
    """Columns of longs: hashes as they are, the others compressed."""
    import zstandard

    return len(rows).to_bytes(8, "little") + rows[:, 0].tobytes() + rows[:, 1].tobytes() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(rows[:, 2:].T).tobytes())


def unpacking(data: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    hashes = np.frombuffer(data, np.int64, 2 * n, 8).reshape(2, n)
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 + 16 * n :]), np.int64).reshape(4, n)
    return np.concatenate([hashes, rest]).T


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, id, spans: arrays of [begin, end) byte ranges to remove, for documents that have any; see keyed()."""
    docs = keyed(docs)
    spark = docs.sparkSession
    asked = written(requests(docs, length), "requests")
    compare = asked.where(f"code <> {WHOLE}").groupBy("key", "id").agg(F.collect_set(F.struct("begin", "n", "code", "marker")).alias("asked"))

    places = max(shuffle_partitions(spark), asked.where(f"code <> {WHOLE}").count() * 3 * length // (2 * MERGE_BYTES))
    sent_kind = "place int, before binary, starts binary, texts binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, size = [], [], 0
        for part in slices(batches, 64):
            for key, i, text, asks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = text.encode()
                for a in asks:
                    piece = raw[a["begin"] : a["begin"] + a["n"] + length - 1]
                    parts = [(a["marker"], 0, a["n"])]
                    if a["code"] & HOT:
                        found = segments(piece, np.array([len(piece)] * 2), length, min(LONG_MARKER, length))
                        parts = list(zip(found[0].view(np.int64).tolist(), found[2].tolist(), found[3].tolist(), strict=True))
                    for marker, at, n in parts:
                        rows.append((marker, key, i, a["begin"] + at, a["code"] & ~HOT))
                        texts.append(piece[at : at + n + length - 1])
                        size += len(texts[-1])
                        if size >= SHARD_BYTES:
                            yield shard(rows, texts)
                            rows, texts, size = [], [], 0
        if rows:
            yield shard(rows, texts)

    def shard(rows: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
        """The shard's transform, split by place."""
        known = np.array(rows, np.int64)
        place = (mixed(known[:, 0].view(np.uint64)) % np.uint64(places)).astype(np.int64)
        before, whole, owner = transform(texts)
        by = np.argsort(place[owner], kind="stable")
        before, whole, at = before[by], whole[by], place[owner[by]]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))), len(at))
        starts, by_text = np.flatnonzero(whole), np.argsort(place, kind="stable")
        known = np.concatenate([known[:, 1:], np.array([[len(t)] for t in texts])], axis=1)[by_text]
        text_cuts = np.append(np.flatnonzero(np.concatenate(([True], place[by_text][1:] != place[by_text][:-1]))), len(place))
        made = [
            (int(at[a]), before[a:b].tobytes(), (starts[c:d] - a).astype(np.int32).tobytes(), known[c:d].tobytes())
            for (a, b), (c, d) in zip(itertools.pairwise(cuts.tolist()), itertools.pairwise(text_cuts.tolist()), strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["place", "before", "starts", "texts"])

    sent = docs.join(compare, ["key", "id"]).select("key", "id", "text", "asked").mapInArrow(send, sent_kind)

    def merge(table: pa.Table) -> pa.Table:
        before, starts, texts = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("before", np.uint8), ("starts", np.int32), ("texts", np.int64)))
        shard_rows, shard_texts = np.array([len(x) for x in before]), np.array([len(x) for x in starts])
        known = np.concatenate(texts).reshape(-1, 5)
        whole = np.zeros(shard_rows.sum(), bool)
        whole[np.concatenate(starts) + np.repeat(np.cumsum(shard_rows) - shard_rows, shard_texts)] = True
        owner, found = merged_repeats(np.concatenate(before), whole, shard_rows, shard_texts, known[:, 4], length)
        asked = known[owner, 3] == NEED
        owner, found = owner[asked], found[asked]
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (found[1:] - found[:-1] > length))) if len(owner) else np.empty(0, bool)
        last = np.append(first[1:], True) if len(owner) else first
        who = known[owner[first]]
        return pa.table([pa.array(x) for x in (who[:, 0], who[:, 1], who[:, 2] + found[first], who[:, 2] + found[last] + length)], names=["key", "id", "begin", "end"])

    compared = sent.groupBy("place").applyInArrow(merge, "key long, id long, begin long, end long")
    whole = asked.where(f"code = {WHOLE}").select("key", "id", "begin", (F.col("begin") + F.col("n") + F.lit(length - 1)).alias("end"))
    return whole.unionByName(compared).groupBy("key", "id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all columns, with text without its repeated strings (a character cut in part goes as a whole) and, if there, n_chars to match."""
    spans = repeated_spans(docs, length)
    names, schema = docs.columns, docs.schema
    text = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, body = f"_c{names.index('doc_id')}", f"_c{text}"
    found = inner.withColumn("_key", F.xxhash64(doc_id, body)).withColumn("_id", F.coalesce(doc_id, F.lit(-1)))
    found = found.join(spans, (F.col("_key") == F.col("key")) & (F.col("_id") == F.col("id")), "left").select(*[f"_c{i}" for i in range(len(names))], "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, columns = [], list(part.columns[:-1])
            for t, s in zip(part.column(text).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                texts.append(kept(t.encode(), [(x["begin"], x["end"]) for x in s])[0].decode(errors="ignore") if s else t)
            columns[text] = pa.array(texts, part.schema.field(text).type)
            if count is not None:
                had, spans = part.column(count).to_pylist(), part.column(len(names)).to_pylist()
                columns[count] = pa.array([len(t) if s else n for t, n, s in zip(texts, had, spans, strict=True)], part.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"_c{i}" for i in range(len(names))])

    kinds = T.StructType([T.StructField(f"_c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return found.mapInArrow(cut, kinds).toDF(*names)


def kept(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of raw, and the maximal runs that are removed."""
    runs = joined_runs(spans)
    cuts = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)), runs


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text)."""
    spans = repeated_spans(docs, length)
    joined = pick(docs, doc_id="doc_id", text="text").select("doc_id", *[F.xxhash64("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("id")], "text").join(spans, ["key", "id"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = (text or "").encode()
                rest, runs = kept(raw, [(x["begin"], x["end"]) for x in spans or []])
                rows.append((doc_id, len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
w AS (SELECT k, i, sha256(substr(h, 2 * i + 1, 400)) AS s FROM d, unnest(range(0, n_bytes - 199)) AS t(i)),
m AS (SELECT k, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) > 200 AS gap FROM m),
u AS (SELECT k, i, sum(CASE WHEN coalesce(gap, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT k, min(i) AS a, max(i) + 200 AS b FROM u GROUP BY k, run),
q AS (SELECT k, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM r GROUP BY k)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(array_to_string(list_transform(range(0, coalesce(n_spans, 0) + 1), lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1, 2 * (coalesce(starts[j + 1], n_bytes) - CASE WHEN j = 0 THEN 0 ELSE ends[j] END))), ''))) AS kept_sha256
FROM d LEFT JOIN q USING (k)
"""
