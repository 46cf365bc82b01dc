"""The ten operations against brute force, with the odd cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parqsieve.llm import chat, decontaminate, embeddings, html_crf, minhash, packing, suffixes, tokens, toxicity, warc
from parqsieve.llm.common import scratch_path
from parqsieve.llm.components import components

DOCS = "doc_id long, text string, DOC_ID string, key string, n_bytes int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "théta"]) + str(rng.randint(0, 60)) for _ in range(n))


def odd_texts(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    return [base, base, base.replace("beta", "BETA"), base + " " + sentence(rng, 8), None, "", "   ", "one", "One", "ab" * 600, sentence(rng, 300), "line\n" * 200, sentence(rng, 40) + base[:400] + sentence(rng, 40), "ü" * 500]


def test_tokens(spark):
    texts = [*odd_texts(), "<|endoftext|> a", "日本語 text x", sentence(random.Random(5), 30_000)]
    coder = tokens.encoder()
    want = [len(coder.slow.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.doc_id: r for r in tokens.token_counts(docs(spark, texts)).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert tokens.token_counts(docs(spark, [])).count() == 0
    data = texts[-1][:20_000]
    for chunk, overlap in ((300, 20), (1000, 64), (64, 8)):
        made = np.concatenate(list(tokens.spliced(data.encode(), coder.ids, coder.lengths, chunk, overlap)))
        assert made.tolist() == coder.slow.encode(data, add_special_tokens=False).ids
    glued = ("x" * 900 + " é<|endoftext|>") * 3
    assert np.concatenate(list(tokens.spliced(glued.encode(), coder.ids, coder.lengths, 100, 20))).tolist() == coder.slow.encode(glued, add_special_tokens=False).ids


def test_plain_characters_are_alike_in_both_libraries():
    coder = tokens.encoder()
    for c in map(chr, range(0x2100)):
        if tokens.PLAIN.search(c) is None:
            for text in (f"a{c}b", f" {c} {c}{c}1", f"{c}  {c}\n\n{c}'s", f"1{c}2 .{c}."):
                assert coder.fast.encode(text, allowed_special="all") == coder.slow.encode(text, add_special_tokens=False).ids, hex(ord(c))


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_decontamination(spark, block_bytes):
    rng = random.Random(2)
    items = [sentence(rng, 14), "Just Three words", None, "", sentence(rng, 10)]
    items += ["new " + items[0] + " tail", "on and " * 12, "just three words", items[4]]
    texts = [*odd_texts(), "x " + items[0] + " y", items[0][5:] + " just three WORDS", items[4], items[4], "on and " * 9]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = []
    for i, t in enumerate(texts):
        w, hit, named = words(t), set(), set()
        for k, item in enumerate(items):
            v = words(item)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        named.add(str(k))
        want.append((i, len(w), sorted(hit), sorted(named)))
    made = decontaminate.contamination(docs(spark, texts), table, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.n_words, [x for a in r.runs for x in range(a["first"], a["last"] + 1)], r["items"]) for r in made) == want
    clean = decontaminate.decontaminate(docs(spark, texts), table, block_bytes=block_bytes)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, _, h, _ in want if not h] and clean.columns == DOCS.replace(",", " ").split()[::2]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs(spark, texts), table, remove="spans").collect()}
    assert cut[len(odd_texts())] == "x  y"
    assert decontaminate.contamination(docs(spark, texts), table.limit(0)).where("size(runs) > 0").count() == 0


def test_html(spark):
    field = html_crf.default_field()
    held_out = html_crf.labelled_pages(60, seed=11)
    right = sum(x == y for blocks, labels in held_out for x, y in zip(field.decode(blocks), labels, strict=True))
    assert right / sum(len(labels) for _, labels in held_out) > 0.98
    page = "<html><nav><a>Menu</a></nav><article><h1>A&amp;B</h1><p>Some\n  text of<br>the <b>page</b>, long enough.<p>More text here.</article><footer>&copy; x</footer><script>var a='</p>'"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_crf.extract(rows).collect()) == [(1, "A&B\n\nSome text of the page, long enough.\n\nMore text here."), (2, ""), (3, ""), (3, "")]


def test_viterbi_finds_the_best_path():
    rng = random.Random(4)
    field = html_crf.Field({"a": 0.7, "b": -1.1}, 0.3, (0.5, -0.8, -0.2, 0.9))
    for _ in range(20):
        blocks = [((rng.choice("ab"),), "text", 0.0) for _ in range(6)]
        scores = field.scores(blocks)
        value = lambda path: scores[0] * path[0] + 0.3 * path[0] + sum(s * y + field.steps[2 * x + y] for s, x, y in zip(scores[1:], path, path[1:], strict=False))
        best = max(([k >> i & 1 for i in range(6)] for k in range(64)), key=value)
        assert abs(value(best) - value([int(x) for x in field.decode(blocks)])) < 1e-9


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://b.example/x", big), (2, "http://a.example/", big), (9, None, big), (4, "http://a.example/", "small"), (6, "u\r\nv w", "small"), (7, "http://[bad", None), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    index = warc.build_index(warc.captures(spark, path), block_captures=2)
    assert index.count() > 2
    got = {r.page_id: r for r in warc.look_up(spark, index, pages).collect()}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 2, 9: 2}
    assert warc.look_up(spark, index, pages.where("page_id = 6")).count() == 1


def windows(texts, n=200):
    seen = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for a in range(len(raw) - n + 1):
            seen.setdefault(raw[a : a + n], []).append((i, a))
    out = {}
    for spots in seen.values():
        if len(spots) > 1:
            for i, a in spots:
                out.setdefault(i, set()).update(range(a, a + n))
    return out


def test_suffixes(spark):
    rng = random.Random(8)
    shared = sentence(rng, 60)
    texts = [*odd_texts(), *[sentence(rng, rng.randint(1, 30)) + shared[rng.randint(0, 90) : -rng.randint(1, 90)] + sentence(rng, 9) for _ in range(12)], "a" * 199, "b" * 200, "c" * 201]
    gone = windows(texts)
    made = {r.doc_id: r for r in suffixes.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        rest = bytes(b for k, b in enumerate(raw) if k not in gone.get(i, ()))
        cut = gone.get(i, set())
        assert (made[i].n_bytes, made[i].n_removed, made[i].kept_sha256) == (len(raw), len(cut), hashlib.sha256(rest).hexdigest()), i
        assert made[i].n_spans == sum(k - 1 not in cut for k in cut)
    left = suffixes.remove_repeats(docs(spark, texts))
    assert left.count() == len(texts) and left.columns[2] == "DOC_ID"
    assert suffixes.digest(docs(spark, [])).count() == 0
    assert sorted(r.n_removed for r in suffixes.digest(docs(spark, ["short", None, "short"])).collect()) == [0, 0, 0]


def test_minhash(spark):
    rng = random.Random(9)
    base = sentence(rng, 200).split()
    texts = odd_texts()
    for _ in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randint(0, 99)
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = up[i], up[j]
                up = [min(x, y) if z in (x, y) else z for z in up]
    for block in (minhash.BLOCK, 5):
        made = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), block=block).collect()}
        assert [made[i].component_id for i in range(len(texts))] == up
    assert [made[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert minhash.keep_one(docs(spark, texts)).count() == len(set(up))
    twice = minhash.near_duplicates(docs(spark, ["a b", "c d", "a b"], [1, 1, None])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in twice) == [(False, 1, True), (False, 1, True), (True, None, True)]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = base[:20] + 0.05 * rng.standard_normal((20, 16))
    rows = [(i, [float(np.float32(x)) for x in v], "z") for i, v in enumerate(np.concatenate([base, near, base[:3]]))]
    odd = [(100, None, ""), (101, [0.0] * 16, ""), (102, [float("nan")] + [1.0] * 15, ""), (103, [None] + [1.0] * 15, ""), (104, [], ""), (None, [1.0] * 16, ""), (105, [1.0] * 3, ""), (106, [2.0] * 3, "")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, component string")
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    for block in (None, 7):
        made = {r.vec_id: r for r in embeddings.link(table, block=block).collect()}
        assert [made[i].n_links for i in range(len(x))] == linked.sum(1).tolist()
        assert all(made[i].component_id == i % 60 if i < 80 else made[i].component_id == i - 80 for i in range(len(x)))
        assert [made[i].n_links for i in (100, 101, 102, 103, 104, None, 105, 106)] == [0] * 6 + [1, 1]


def test_packing(spark):
    texts = odd_texts() * 3 + [sentence(random.Random(k), 40 * k) for k in range(30)]
    coder = tokens.encoder()
    made = packing.pack(docs(spark, texts), capacity=128).collect()
    for i, t in enumerate(texts):
        ids = np.array([*coder.slow.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4")
        mine = sorted((r for r in made if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist() and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    sequences = {}
    for r in made:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1].tolist()] and ends[-1] <= 128
    assert len(sequences) <= 1.03 * sum(r.length for r in made) / 128 + 1
    assert packing.plan({}) == [] and packing.plan({5: 3}, 10) == [((5, 5), 1), ((5,), 1)]


def test_toxicity(spark):
    rng = random.Random(6)
    texts = [sentence(rng, rng.randint(5, 60)) for _ in range(400)]
    flags = [i % 5 == 0 for i in range(400)]
    texts = [t + "".join(" " + rng.choice(["scumbag", "scumlord", "vileness"]) for _ in range(rng.randint(1, 6))) if f else t for t, f in zip(texts, flags, strict=True)]
    table = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([*[(i, int(f)) for i, f in enumerate(flags[:300])], (None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    assert len(model.thresholds) == 1  # the labels hold two grades
    graded = {r.doc_id: r.toxicity for r in toxicity.grade(table, model).collect()}
    assert sum(graded[i].toxic == f for i, f in enumerate(flags) if i >= 300) >= 98
    assert not graded[400].toxic and not graded[401].toxic
    assert toxicity.grade(table, toxicity.train(table, labels.limit(0))).where("toxicity.toxic").count() == 0


def test_ordered_thresholds_are_the_likelihoods_own():
    """Three grades from a latent score: no step away from the fitted weights and thresholds makes the labels likelier."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (4000, 6))
    latent = x @ np.array([1.6, 1.2, 0.9, -1.1, -1.4, 1.0]) + rng.logistic(size=4000)
    grades = (latent > 1.0).astype(int) + (latent > 2.5) + (latent > 4.0)
    model = toxicity.fit([np.flatnonzero(r) + 100 for r in x], grades, rounds=1200, l1=0.0)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    names = sorted(model.weights)

    def loss(w, t):
        score = x[:, [k - 100 for k in names]] @ w
        below = np.concatenate([np.zeros((4000, 1)), 1 / (1 + np.exp(score[:, None] - t)), np.ones((4000, 1))], axis=1)
        rows = np.arange(4000)
        return -np.log(below[rows, grades + 1] - below[rows, grades]).mean()

    w, t = np.array([model.weights[k] for k in names]), np.array(model.thresholds)
    for k in range(len(w) + 3):
        for step in (0.1, -0.1):
            move = np.eye(len(w) + 3)[k] * step
            assert loss(w + move[: len(w)], t + move[len(w) :]) > loss(w, t)
    assert np.abs(t - [1.0, 2.5, 4.0]).max() < 0.4
    severity = sum(model.above(2.0))
    assert 0 < severity < 3 and abs(severity - sum(1 / (1 + np.exp(t - 2.0)))) < 1e-9


def test_toxicity_with_clashing_names(spark):
    table = spark.createDataFrame([(i, "vile scum talk" if i % 2 else "kind calm talk", "a", "b") for i in range(60)], "doc_id long, text string, toxicity string, Toxicity_ string")
    model = toxicity.train(table, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert toxicity.grade(table, model).columns == [*table.columns, "toxicity__"]
    clean = toxicity.without_toxic(table, model)
    assert clean.columns == table.columns and sorted(r[0] for r in clean.collect()) == list(range(0, 60, 2))


def test_long_texts_without_ascii(spark):
    """Time in proportion to the length, with and without stable places, and the library's own counts."""
    import time

    coder = tokens.encoder()
    rng = random.Random(3)
    line = lambda n: "".join(chr(rng.randint(0x4E00, 0x5000)) for _ in range(n))
    for make in (lambda n: "".join(line(30) + rng.choice("。\n，！") for _ in range(n)), lambda n: "".join(line(30) + "。\n" for _ in range(n)), lambda n: "".join(f"Привет {line(9)}\t" for _ in range(n * 2))):
        text = make(3000)
        assert np.concatenate(list(coder.pieces(text))).tolist() == coder.slow.encode(text, add_special_tokens=False).ids
        for chunk, overlap in ((200, 16), (3000, 64)):
            part = text[:4000]
            assert np.concatenate(list(tokens.spliced(part.encode(), coder.ids, coder.lengths, chunk, overlap))).tolist() == coder.slow.encode(part, add_special_tokens=False).ids
    solid = line(20_000)
    assert sum(map(len, coder.pieces(solid))) == len(coder.slow.encode(solid, add_special_tokens=False).ids)
    texts = [make(8000), make(32_000)]
    took = []
    for text in texts:
        began = time.time()
        sum(map(len, coder.pieces(text)))
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "b"), (2, 0, "system", "x"), (None, 0, "ann", "q"), (3, None, None, "t")], "conv_id long, turn long, role string, text string")
    made = {(r.conv_id, r.speaker): r for r in chat.rotate(turns).collect()}
    assert set(made) == {(1, "ann"), (1, "bob"), (3, "unknown")}
    ann = made[1, "ann"]
    assert ann.labels == [0, 1, 1, 0] and [ann.rendered[s.begin : s.end] for s in ann.spans] == ["hi", "b"]
    assert "user name=bob" in ann.rendered and made[1, "bob"].labels == [0, 0, 0, 1]
    for r in made.values():
        assert [r.rendered[s.begin : s.end] for s in r.spans] == [{"ann": ["hi", "b"], "bob": [""], "unknown": ["t"]}[r.speaker][k] for k in range(sum(r.labels))]


def test_minhash_of_a_large_family(spark):
    """5,000 different texts of one family, in blocks, and stragglers that only some of them link with."""
    rng = random.Random(12)
    base = ["word%d" % rng.randint(0, 9999) for _ in range(60)]
    texts = [" ".join([*base[:k % 50], "edit%d" % k, *base[k % 50 + 1 :]]) for k in range(5000)]
    texts += [" ".join([*t.split()[:52], *("tail%d" % rng.randint(0, 99) for _ in range(8))]) for t in texts[:20]]  # less alike than 0.75 to most
    made = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    assert all(made[i].component_id == 0 for i in range(5000))
    linked = [any(100 * len(s & o) >= 75 * len(s | o) for o in sets[:5000]) for s in sets[5000:]]
    assert [made[5000 + i].component_id == 0 for i in range(20)] == linked


def test_hubs_and_hot_keys(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(1001, 1300)] + [(1299, 2000), (2000, 2001), (5, 5), (None, 3)]
    made = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1300)} | {2000: 1000, 2001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_a_group_stays_whole(spark):
    texts = ["first text of one id", "second and quite another text", "something else", "something else", "x"]
    table = spark.createDataFrame([(1, texts[0], 1), (1, texts[1], 2), (1, texts[1], 3), (3, texts[2], 4), (4, texts[3], 5), (None, texts[3], 6)], "doc_id long, text string, DOC_ID int")
    kept = sorted((str(r[0]), r[1]) for r in minhash.keep_one(table).collect())
    assert kept == sorted([("1", texts[0]), ("1", texts[1]), ("3", texts[2]), ("None", texts[3])])


@pytest.mark.parametrize("seed", range(6))
def test_merged_transforms_find_what_brute_force_finds(seed):
    rng = random.Random(seed)
    shared = [bytes(rng.choice(b"ab\x00\xff") for _ in range(40)) for _ in range(3)]
    shards = [[b"".join(rng.choice([*shared, bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 6))] for _ in range(4)]
    shards.append([b"a" * 100, b"", b"a" * 99])
    made = [suffixes.transform(texts) for texts in shards]
    for texts, (before, whole, owner) in zip(shards, made, strict=True):
        rows = sorted((t[k:] + b"", i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
        assert [i for _, i, _ in rows] == owner.tolist() and [k == 0 for *_, k in rows] == whole.tolist()
        assert all(w or texts[i][k - 1] == b for (_, i, k), w, b in zip(rows, whole, before, strict=True))
    texts = [t for s in shards for t in s]
    for length in (5, 7, 20, 33):
        spots = {}
        for i, t in enumerate(texts):
            for k in range(len(t) - length + 1):
                spots.setdefault(t[k : k + length], []).append((i, k))
        want = sorted(x for v in spots.values() if len(v) > 1 for x in v)
        owner, at = suffixes.merged_repeats(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), np.array([len(m[0]) for m in made]), np.array([len(s) for s in shards]), np.array([len(t) for t in texts]), length)
        assert list(zip(owner.tolist(), at.tolist(), strict=True)) == want


def test_suffixes_with_hot_markers(spark, monkeypatch):
    rng = random.Random(21)
    passage = sentence(rng, 30)[:150]
    texts = [sentence(rng, 30) + passage + sentence(rng, 30)[: rng.randint(1, 90)] for _ in range(30)]
    texts += [sentence(rng, 3) + texts[k % 30][100:-20] for k in range(20)] + ["ab" * 9000, "x" + "ab" * 5000]
    monkeypatch.setattr(suffixes, "HOT_KINDS", 3)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    gone = windows(texts)
    made = {r.doc_id: r for r in suffixes.digest(docs(spark, texts)).collect()}
    assert [made[i].n_removed for i in range(len(texts))] == [len(gone.get(i, ())) for i in range(len(texts))]


P = "The committee met on Tuesday to discuss the plans for the new bridge, which has been delayed twice since the spring. "
Q = "Several members said that the costs had risen, and that a decision could not wait any longer than the autumn. "
R = "Nobody knows when the work will begin, but most expect that it will be after the winter. "
HAND_MADE = [
    (f'<html><head><title>T</title><style>p {{}}</style></head><body><div id="top"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></div><div id="bodytext"><h1>Bridge delayed again</h1><p>{P}{Q}</p><p>{R}{P}</p></div><div class="footer">&copy; 2020 The Paper. All rights reserved.</div></body></html>',
     ["Bridge delayed again",P+Q,R+P]),
    (f'<body><nav><a href="/">Start</a> | <a href="/b">Blog</a></nav><div class="entry-content"><p>{P}</p><ul><li>{Q}</li><li>{R}</li></ul><p>{R}{Q}</p></div><aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Another thing</a></li></ul></aside><div id="comments"><p>{Q}</p></div></body>',
     [P,Q,R,R+Q]),
    (f'<table><tr><td><a href=1>Index</a><br><a href=2>Archive</a><br><a href=3>Links</a></td><td><p>{P}{Q}<p>{Q}{R}<p>{R}{P}</td></tr></table>',
     [P+Q,Q+R,R+P]),
    (f'<main><header><h1>My site</h1></header><article><h2>On bridges</h2><p>{P}<svg viewBox="0 0 1 1"/> {Q}</p><blockquote><p>{R}</p></blockquote><p>{Q}</p></article></main><footer><p>{R}</p></footer>',
     ["On bridges",P+Q,R,Q]),
    (f'<div class="xqz"><div class="zz1"><p>{P}{R}</p><p>{Q}{P}</p><p>{R}{R}</p></div><div class="cookie-consent"><p>We use cookies to make this site better for you. <button>OK</button></p></div></div>',
     [P+R,Q+P,R+R]),
    (f'<body><h1>A plain page</h1><p>{P}{Q}</p><p>{Q}{R}</p></body>',["A plain page",P+Q,Q+R]),
]


@pytest.mark.parametrize("k", range(len(HAND_MADE)))
def test_pages_of_other_hands(k):
    """Layouts that the generator of the training pages doesn't write."""
    page, want = HAND_MADE[k]
    assert html_crf.default_field().main_text(page) == "\n\n".join(" ".join(x.split()) for x in want)


def test_broken_markup_loses_no_text_and_no_time():
    import time

    texts = lambda page: [t for _, t, _ in html_crf.leaf_blocks(page)]
    assert texts('<p>a</p><svg viewBox="0 0 1 1"/><p>b</p>') == ["a", "b"]
    assert texts("<p>a<button>go<p>b") == ["ago", "b"]
    assert texts("<p>a</p><select><option>x<p>b</p>")[-1] == "b" and texts("<p>a<select><option>x</select> b")== ["a b"]
    assert texts("<p>a <svg><text>t</text><svg></svg></svg>b") == ["a b"]
    assert texts("<p>a<!-- <p>x --> b<script>'<p>'</script><style>p{}</style></p>1 < 2 & 3 > 2") == ["a b", "1 < 2 & 3 > 2"]
    assert texts("<p title='>' class=\"x>y\">a</p><p title=\">b</p>") == ["a", "b"]
    assert texts("") == texts("<p></p>") == []
    assert texts("<p>a</p><!-- b") == ["a"] and texts("<p>a</p> b <c <!-- d") == ["a", "b <c"]
    for part in ("<a ", '<a x="', "<div>x", "<svg>", "<a x='>", "<!--", '<a x=">" ', "<textarea>", "<p><i>", "</b>", "<b></i>"):
        began = time.time()
        html_crf.leaf_blocks(part * (300_000 // len(part)))
        assert time.time() - began < 5, part
    assert texts("<a " * 16_000 + "x")


def test_html_of_odd_tables(spark):
    kind = "page_id long, url string, html string, TEXT string, text string, Page_Id int"
    field = html_crf.default_field()
    long = "<article>" + "<p>Some words in a paragraph, of a long page.</p>" * 20_000 + "</article>"
    rows = spark.createDataFrame([(1, None, long, "a", "b", 3), (None, "u", "<p>", "a", "b", 3), (1, None, long, "a", "b", 3)], kind)
    made = html_crf.extract(rows, field).collect()
    n = 20_000 * (len("Some words in a paragraph, of a long page.") + 2) - 2
    assert sorted(r.n_chars for r in made) == [0, n, n] and all(len(r.text) == r.n_chars for r in made)
    assert html_crf.extract(rows.limit(0), field).count() == 0


def test_warc_of_odd_tables(spark):
    """Repeated page_ids and rows, a very long page, other columns, small archives, and an empty table."""
    import io

    big, long = "<p>" + "y" * 300, "<p>" + "".join(random.Random(2).choice("abcdefgh ü") for _ in range(3_000_000))
    rows = [(3, "http://a/", big, "x"), (3, "http://a/", big, "x"), (3, "http://b/", "other" * 40, "x"), (5, "http://c/", big, "x"), (8, "http://d/", long, "x"), (9, "http://e/", long, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Page_Id string").repartition(2, "url").sortWithinPartitions("url")
    path = scratch_path(spark, "warc-odd")
    warc.write_archives(pages, path, records=2)
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() >= 3
    index = warc.build_index(warc.captures(spark, path), block_captures=2)
    made = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.look_up(spark, index, pages).collect())
    n = len(long.encode())
    assert made == sorted([(3, 303, "response", None)] * 2 + [(3, 200, "response", None), (5, 303, "revisit", 3), (8, n, "response", None), (9, n, "revisit", 8)], key=lambda r: r[:3])
    data = b"".join(warc.member(warc.record(warc.record_id(i, i), None, b"z" * i, "d", None)) for i in range(300))
    found = list(warc.members(io.BytesIO(data)))
    assert len(found) == 300 and [o for o, *_ in found] == [0, *np.cumsum([n for _, n, _ in found])[:-1].tolist()]
    assert all(warc.inflate(data[o : o + n]) == c for o, n, c in found)
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(io.BytesIO(data[:-30])))
    empty = scratch_path(spark, "warc-empty")
    warc.write_archives(pages.limit(0), empty)
    assert warc.look_up(spark, warc.build_index(warc.captures(spark, empty)), pages.limit(0)).count() == 0


def test_empty_tables_and_clashing_names(spark):
    empty = docs(spark, [])
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0
    assert packing.pack(empty).count() == 0 and decontaminate.contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, rep int, copies int")
    assert embeddings.link(vectors).count() == 0
    turns = spark.createDataFrame([(1, 0, "ann", "hi", 7, 8), (1, 0, "ann", "hi", 7, 8), (1, 1, "bob", "", 7, 8)], "conv_id long, turn long, role string, text string, at int, speaker int")
    made = {r.speaker: r for r in chat.rotate(turns).collect()}
    assert made["ann"].n_turns == 3 and [made["ann"].rendered[s.begin : s.end] for s in made["ann"].spans] == ["hi", "hi"]
    assert chat.rotate(turns.limit(0)).count() == 0
    assert toxicity.grade(empty, toxicity.Ordinal({}, [])).count() == 0


def test_long_texts_in_pieces():
    rng = random.Random(4)
    text = sentence(rng, 400).encode().lower() + b"x" * 300 + b" \xff end"
    for size in (1, 7, 50, 1000):
        assert b"".join(decontaminate.pieces(text, size)) == text
        assert [w for p in decontaminate.pieces(text, size) for w in decontaminate.WORD.findall(p)] == decontaminate.WORD.findall(text)
    assert list(decontaminate.pieces(b"", 5)) == [b""] and list(decontaminate.pieces(b"a" * 20, 5)) == [b"a" * 20]
    found = decontaminate.spots(text, {0, 3})
    assert [text[a:b] for a, b in found.values()] == [decontaminate.WORD.findall(text)[k] for k in (0, 3)]
