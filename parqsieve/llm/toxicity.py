"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k): the thresholds theta share the weights w. x counts, over the distinct words of a
text, each word and each prefix of 4 to 6 letters (prefixes catch the inflected forms). The expected severity is the sum of P(grade > k) over k.

Training: at most ``SAMPLE`` labelled documents of each label, chosen by a hash of doc_id, are read; that is the bound of
the sample, and the model never sees more. Features are kept that lean to either label by ``LEAN`` standard deviations,
and L1 sets the weights of the others to zero. The grades are those of the column ``severity`` if labels have it: as many
ordered thresholds as the highest grade. Labels that only say toxic or not hold two grades, 0 and 1, and no finer
severity can be learnt from them: there is one threshold then, and the expected severity is the probability of toxic.

Null and empty texts have no features and score as such. Labels with null id or flag are left out; of several labels of a
document the highest counts. Without documents of both labels, severity is 0 and nothing is rejected.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.llm.common import map_rows, pick, read_table, slices, written

SAMPLE = 5000
LEAN = 7.0
PREFIXES = (4, 5, 6)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CACHE = 200_000


def words_of(text: str | None) -> set[bytes]:
    return set(WORD.findall((text or "").lower().encode()))


def features(word: bytes) -> list[int]:
    """Numbers of a word and of its prefixes, by letters."""
    letters = word.decode(errors="replace")
    return [zlib.crc32(b"w" + word), *(zlib.crc32(b"p%d" % k + letters[:k].encode()) for k in PREFIXES if len(letters) >= k)]


class Ordinal:
    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds, self.known = weights, thresholds, {}

    def score(self, text: str | None) -> float:
        known, total = self.known, 0.0
        for w in words_of(text):
            if (s := known.get(w)) is None:
                if len(known) >= CACHE:
                    known.clear()
                s = known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            total += s
        return total

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 400, l1: float = 1e-4, rate: float = 0.05) -> Ordinal:
    """rows: the feature numbers of each document, with repeats."""
    grades = np.asarray(grades)
    toxic = grades > 0
    if not len(grades) or toxic.all() or not toxic.any():
        return Ordinal({}, [])
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    names, column = np.unique(flat, return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), sizes)
    cell, count = np.unique(doc * len(names) + column, return_counts=True)
    doc, column, value = cell // len(names), cell % len(names), np.minimum(count, 4).astype(float)
    n1, n0 = toxic.sum(), (~toxic).sum()
    a, b = np.bincount(column[toxic[doc]], minlength=len(names)) / n1, np.bincount(column[~toxic[doc]], minlength=len(names)) / n0
    p = (a * n1 + b * n0) / (n1 + n0)
    lean = np.abs(a - b) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    use = (lean >= LEAN) & (p * (n1 + n0) >= 3)
    kept = use[column]
    new = np.cumsum(use) - 1
    doc, column, value = doc[kept], new[column[kept]], value[kept]
    d, top = int(use.sum()), int(grades.max())
    w = np.zeros(d)
    gaps = np.concatenate(([math.log(n0 / n1) if n0 else 0.0], np.zeros(top - 1)))  # the first threshold, then logs of the steps
    m, v = np.zeros(d + top), np.zeros(d + top)
    n, last = len(grades), np.arange(len(grades))
    for t in range(1, rounds + 1):
        theta = gaps[0] + np.concatenate(([0], np.cumsum(np.exp(gaps[1:]))))
        s = np.bincount(doc, weights=w[column] * value, minlength=n)
        f = 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -30, 30)))  # P(grade <= k)
        cdf = np.concatenate([np.zeros((n, 1)), f, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), f * (1 - f), np.zeros((n, 1))], axis=1)
        prob = np.maximum(cdf[last, grades + 1] - cdf[last, grades], 1e-9)
        ds = (slope[last, grades + 1] - slope[last, grades]) / prob  # of -log likelihood
        dtheta = np.zeros(top)
        np.add.at(dtheta, np.minimum(grades, top - 1), np.where(grades < top, -slope[last, grades + 1] / prob, 0))
        np.add.at(dtheta, np.maximum(grades - 1, 0), np.where(grades > 0, slope[last, grades] / prob, 0))
        dgaps = np.concatenate(([dtheta.sum()], [dtheta[k:].sum() * math.exp(gaps[k]) for k in range(1, top)]))
        grad = np.concatenate([np.bincount(column, weights=ds[doc] * value, minlength=d), dgaps]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        if t > rounds // 2:  # the support is found; its weights go on without the penalty
            w, gaps = np.where(w == 0, 0, w - move[:d]), gaps - move[d:]
            continue
        w, gaps = w - move[:d], gaps - move[d:]
        shrink = rate * l1 / (np.sqrt(v[:d] / (1 - 0.99**t)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    theta = gaps[0] + np.concatenate(([0], np.cumsum(np.exp(gaps[1:]))))
    ids = names[use]
    return Ordinal({int(ids[i]): float(w[i]) for i in np.flatnonzero(w)}, [float(x) for x in theta])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model of docs (doc_id, text) with labels (doc_id, toxic and perhaps severity)."""
    column = "severity" if "severity" in labels.columns else "toxic"
    labels = pick(labels, doc_id="doc_id", grade=column).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = labels.where("grade <= 0").orderBy(*order).limit(sample).unionByName(labels.where("grade > 0").orderBy(*order).limit(sample))
    docs = pick(docs, doc_id="doc_id", text="text").where("text is not null")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for part in slices(batches):
            word_ids, others = [], []
            for text in part.column(2).to_pylist():
                if len(known) > CACHE:
                    known.clear()
                found = []
                for w in sorted(words_of(text)):
                    if w not in known:
                        known[w] = features(w)
                    found.append(known[w])
                word_ids.append([f[0] for f in found])
                others.append([x for f in found for x in f[1:]])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(word_ids, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64()))], names=["doc_id", "grade", "words", "prefixes"])

    # broadcast: at most twice the sample of (id, grade)
    spark = docs.sparkSession
    rows = written(F.broadcast(chosen).join(docs, "doc_id").select("doc_id", "grade", "text").mapInArrow(featurise, "doc_id long, grade int, words array<long>, prefixes array<long>"), "labelled")
    n1, n0 = rows.where("grade > 0").count(), rows.where("grade <= 0").count()
    if not n1 or not n0:
        return Ordinal({}, [])
    toxic = (F.col("grade") > 0).cast("int")
    one = lambda name: rows.select(toxic.alias("toxic"), F.lit(name).alias("kind"), F.explode(F.array_distinct(name)).alias("feature"))
    counts = one("words").unionByName(one("prefixes")).groupBy("kind", "feature").agg(F.sum("toxic").alias("inside"), F.sum(1 - F.col("toxic")).alias("outside"))
    share = (F.col("inside") + F.col("outside")) / (n1 + n0)
    leans = F.abs(F.col("inside") / n1 - F.col("outside") / n0) >= LEAN * F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    held = spark.sparkContext.broadcast({r.feature for r in counts.where(leans).select("feature").collect()})  # of the sample, so bounded with it

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = held.value
        for part in slices(batches):
            words, prefixes = part.column(2).to_pylist(), part.column(3).to_pylist()
            kept = [[f for f in (*w, *p) if f in use] for w, p in zip(words, prefixes, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "grade", "features"])

    small = rows.mapInArrow(reduce, "doc_id long, grade int, features array<long>").toArrow().sort_by([("doc_id", "ascending")])
    grades = np.maximum(small.column("grade").to_numpy().astype(np.int64), 0)
    return fit([np.asarray(x.values) for x in small.column("features")], grades)


GRADED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])


def grade(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs, all columns, and as its last one a struct: score, severity (expected), grade (with even odds or more to be reached), toxic (grade above 0).

    The last column is named toxicity, with as many underscores behind as it takes to clash with no other name."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # at most as many weights as the sample has features
    place, name = docs.columns.index("text"), "toxicity"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    out = pa.struct([("score", pa.float64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*held.value)
        for part in slices(batches):
            rows = []
            for text in part.column(place).to_pylist():
                s = own.score(text)
                p = own.above(s)
                g = sum(x >= 0.5 for x in p)
                rows.append({"score": s, "severity": float(sum(p)), "grade": g, "toxic": g > 0})
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, out)], names=[*part.schema.names, f"_c{part.num_columns}"])

    return map_rows(docs, run, T.StructField(name, GRADED))


def without_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs, all columns, without the rows that are toxic; columns go by place, so any names do."""
    names = docs.columns
    graded = grade(docs, model).toDF(*[f"_c{i}" for i in range(len(names))], "_toxicity")
    return graded.where(~F.col("_toxicity.toxic")).drop("_toxicity").toDF(*names)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    graded = grade(pick(docs, doc_id="doc_id", text="text"), train(docs, read_table(spark, sf_dir, "labels")))
    return graded.select("doc_id", F.round("toxicity.severity", 6).alias("severity"), F.col("toxicity.grade").alias("grade"), F.col("toxicity.toxic").alias("toxic"))
