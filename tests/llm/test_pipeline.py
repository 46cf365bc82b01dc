"""The whole pipeline on a small table against brute force, stage by stage."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from parqsieve.llm import packing, tokens, toxicity
from parqsieve.llm.common import read_table

from test_llm import sentence, windows

KIND = "doc_id long, text string, lang string, source string, n_chars long, Toxicity string, spans string, _text int"
VILE = ["scumbag", "scumlord", "vileness", "vilest"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    shared, base = sentence(rng, 40), sentence(rng, 80).split()
    items = [sentence(rng, 13), "only three words", "", None]
    texts = [sentence(rng, rng.randint(5, 90)) for _ in range(60)]
    texts += [t + " " + " ".join(rng.choices(VILE, k=4)) for t in texts[:30]]
    texts += [" ".join([*base[:k], "edit%d" % k, *base[k + 1 :]]) for k in range(10, 16)]  # near copies
    texts += [texts[3], texts[3].upper(), texts[4] + " "]  # exact copies, and a copy in capitals
    texts += [sentence(rng, 20) + " " + shared + " " + sentence(rng, 20) for _ in range(4)]  # a passage of many documents
    texts += [sentence(rng, 9) + " " + items[0].upper() + " " + sentence(rng, 9), sentence(rng, 30) + " Only three words."]
    texts += [None, "", "  ", "one", "ü" * 300, sentence(rng, 3000)]
    ids = list(range(len(texts)))
    ids += [7, 8, None]  # an id with another text, a repeated row, a row without an id
    texts += [sentence(rng, 30), texts[8], sentence(rng, 12)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, t, "en", "s", None if t is None else len(t), "a", "b", 1) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(30 <= i - 30 < 60)) for i in range(90)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def words(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def near_kept(rows):
    """Of (id, text): the rows that stay, each group's least id with all its different texts."""
    sets = []
    for _, t in rows:
        w = words(t, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, _), a in zip(rows, sets, strict=True):
        for (j, _), b in zip(rows, sets, strict=True):
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return list(dict.fromkeys((i, t) for i, t in rows if i is not None and root(i) == i)) + [(i, t) for i, t in rows if i is None]


def hit(text, items):
    w = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for item in items:
        v = words(item, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        n = min(10, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
            return True
    return False


def test_pipeline(spark, folder):
    key = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    docs = read_table(spark, folder, "documents")
    now = [(r.doc_id, r[1]) for r in docs.collect()]
    model = toxicity.train(docs, read_table(spark, folder, "labels"))
    assert model.weights
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == [c.split()[0] for c in KIND.split(", ")]
        steps[name] = [(r[0], r[1], r[4]) for r in docs.collect()]
    clean = [(i, t) for i, t in now if not any(p >= 0.5 for p in model.above(model.score(t)))]
    assert key([r[:2] for r in steps["toxicity"]]) == key(clean)
    assert {i for i, _ in clean} & set(range(60, 90)) == set() and len(clean) >= len(now) - 32
    kept = near_kept(clean)
    assert key([r[:2] for r in steps["minhash near-dedup"]]) == key(kept) and len(kept) < len(clean)
    gone = windows([t for _, t in kept])
    cut = [(i, t if t is None else bytes(b for k, b in enumerate(t.encode()) if k not in gone.get(n, ())).decode(errors="ignore")) for n, (i, t) in enumerate(kept)]
    assert key([r[:2] for r in steps["suffix-array dedup"]]) == key(cut) and cut != kept
    assert all(n == (None if t is None else len(t)) for _, t, n in steps["suffix-array dedup"])
    items = [r.text for r in read_table(spark, folder, "benchmark").collect()]
    left = [(i, t) for i, t in cut if not hit(t, items)]
    assert key([r[:2] for r in steps["benchmark decontamination"]]) == key(left) and len(left) < len(cut)

    made = corpus_pipeline.run(spark, folder).collect()
    coder = tokens.encoder()
    want = sorted(len(coder.slow.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in left)
    sizes, sequences = {}, {}
    for r in made:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in sorted(made, key=lambda r: r.piece):
        if r.doc_id is not None and r.doc_id not in (7, 8):
            sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    single = {i: len(coder.slow.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left if i is not None and i not in (7, 8)}
    assert sizes == single and sum(r.length for r in made) == sum(want)
    for spots in sequences.values():
        spots.sort()
        ends = np.cumsum([n for _, n in spots])
        assert [o for o, _ in spots] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.CAPACITY


def test_pipeline_of_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
