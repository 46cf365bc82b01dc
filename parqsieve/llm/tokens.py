"""Token counts of whole texts, however long, with a byte-level BPE.

A text of up to ``CHUNK`` bytes is encoded at once. A longer one is encoded in overlapping chunks with byte offsets.
Two neighbours are spliced at a position that both have as a token boundary and that is proven to be stable, ``MARGIN`` bytes
off either cut: a blank, tab, newline or ideographic space stands after a character that is no white
space, or a punctuation mark beyond ASCII after a letter (of the scripts in ``LETTERS``). No alternative of the splitting pattern spans such a place, and no special string, all
of which are ASCII without white space, so the encoding of the whole text has a boundary there too. Without such a
place the overlap grows fourfold up to the whole left chunk; then the left chunk is encoded anew with twice its length,
so that a text without any stable place is encoded whole after all, and all tries before cost about as much again.

Null and empty texts have no tokens. Each input row gives one row, repeated and null ids included.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parqsieve.llm.common import limit_threads, pick, read_table, slices

CHUNK = 1 << 16
OVERLAP = 512
MARGIN = 16
#: Longer runs without white space go to the library whose merging isn't quadratic.
LONG_RUN = 1000
#: Of these characters two libraries' patterns agree on every class; tests hold this against each character.
PLAIN = re.compile("[^\t\n\r -~¡-¬®-ǃ–—‘-„…€]")
#: A stable boundary: what stands before and after it. Letters and marks of which every version of Unicode agrees what they are.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0905-\u0939\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
MARKS = "\u2010-\u2027\u060c\u061b\u061f\u0964\u0965\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
STABLE = re.compile(f"(?<=[!-~{LETTERS}{MARKS}])(?=[\t\n\r \u3000])|(?<=[{LETTERS}])(?=[{MARKS}])")


class Encoder:
    """ids(text): as ``tokenizers`` gives them for ``vocabulary`` by default. Plain texts take ``ranks``, the same vocabulary for a faster library; the rest take ``tokenizers`` itself."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        limit_threads()
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        self.lengths = np.zeros(1 + max([*table.values(), *special.values()]), np.int64)
        for token, i in [*table.items(), *((k.encode(), v) for k, v in special.items())]:
            self.lengths[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.search(text) is None and max(map(len, text.split()), default=0) <= LONG_RUN and "        " * 64 not in text:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        data = text.encode() if len(text) * 4 > CHUNK else b""
        if len(data) <= CHUNK:
            yield self.ids(text)
        else:
            yield from spliced(data, self.ids, self.lengths)


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    return Encoder(vocabulary, ranks)


def _whole(data: bytes, at: int) -> int:
    """The start of the character that holds byte at."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def stable(data: bytes, spots: np.ndarray) -> int | None:
    """The last of the token boundaries that is proven to be one of the whole text."""
    for at in spots[::-1].tolist():
        if data[at] & 0xC0 != 0x80:  # not within a character
            front = data[max(0, at - 4) : at].decode(errors="ignore")
            if front and STABLE.match(front + data[at : at + 4].decode(errors="ignore"), len(front)):
                return at
    return None


def spliced(data: bytes, ids: Callable[[str], np.ndarray], lengths: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The ids of the whole text, piece by piece, at most a few chunks of it in work as long as there are stable places."""

    def encoded(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        found = ids(data[a:b].decode())
        return found, a + np.cumsum(lengths[found])

    start, end, done = 0, _whole(data, min(chunk, len(data))), 0
    left, left_ends = encoded(start, end)
    while end < len(data):
        wide = overlap
        new_end = _whole(data, min(end + chunk, len(data)))
        if new_end <= end:
            new_end = len(data)
        while True:
            new_start = _whole(data, max(end - wide, start))
            if new_start <= max(start, done):
                start = max(start, done)
                new_end = max(new_end, _whole(data, min(start + 2 * (end - start), len(data))))
                left, left_ends = encoded(start, new_end)
                break
            right, right_ends = encoded(new_start, new_end)
            both = np.intersect1d(left_ends, right_ends, assume_unique=True)
            at = stable(data, both[(both >= max(new_start + MARGIN, done)) & (both <= end - MARGIN)])
            if at is not None:
                yield left[(left_ends > done) & (left_ends <= at)]
                left, left_ends, start, done = right, right_ends, new_start, at
                break
            wide *= 4
        end = new_end
    yield left[left_ends > done]


def token_counts(docs: DataFrame, limit: int = 512, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, ranks)
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = [sum(map(len, coder.pieces(t))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
