"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: the runs of text between block-level tags, each with the chain of its
open elements (the nearest ``ANCESTORS``). Reading a page takes time linear in its length, however broken its markup. Features are the tags, classes and ids of that chain and coarse ones of the text; a block is main text
or not. The field is trained on labelled pages (``labelled_pages`` writes them from a rule, fixed by a seed, nearly half of them with
main text in containers whose names say nothing, so that text features and neighbours have to decide; other labelled pages can
be given) by gradient descent on the exact likelihood, and decoded by Viterbi.

Null and empty pages, and pages without main text, give an empty text. Each input row gives one row. Character
references are decoded, white space inside a block becomes one blank, and blocks are joined by an empty line.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parqsieve.llm.common import pick, read_table, slices

TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|[!?])")
STOP = re.compile(r">|=\s*([\"'])")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style iframe textarea xmp".split())  # their content is no markup
DROPPED = frozenset("template noscript svg math select button datalist".split())  # elements whose content is no text of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: How many open elements up a block looks, and an end tag looks for its start across others.
ANCESTORS, REACH = 64, 256

Block = tuple[tuple[str, ...], str, float]
Token = tuple[int, int, bool, str, str]


def tags(page: str) -> list[Token]:
    """(start, end, whether it is an end tag, name, attributes) of all tags; of comments and the content of RAW elements with an empty name. In time linear in the page.

    A tag that never ends is text. Where quotes don't close, tags from there on end at the next >."""
    out: list[Token] = []
    low, at, last, quotes = page.lower(), 0, page.rfind(">"), True
    missing: set[str] = set()
    while m := TAG.search(page, at):
        start, name = m.start(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            out.append((start, at, False, "", ""))
            continue
        if start >= last:
            at = m.end()
            continue
        end = -1
        if not name or not quotes:
            end = page.find(">", m.end()) + 1
        else:
            spot = m.end()
            while found := STOP.search(page, spot):
                if not found[1]:
                    end = found.end()
                    break
                close = page.find(found[1], found.end())
                spot = close + 1 if close >= 0 else found.end()
            if end < 0:
                quotes, end = False, page.find(">", m.end()) + 1
        if end <= 0:
            break
        at, attributes = end, page[m.end() : end - 1]
        out.append((start, end, bool(m[1]), name, attributes))
        if name in RAW and not m[1] and name not in missing:
            close = low.find(f"</{name}", end)
            if close >= 0 or name in ("script", "style"):
                at = close if close >= 0 else len(page)
                out.append((end, at, False, "", ""))
            else:
                missing.add(name)
    return out


def dropped(tokens: list[Token]) -> dict[int, int]:
    """From the number of a start tag of DROPPED to that of its end tag. One without an end tag, or with another start of its kind before it where these don't nest, has no content."""
    open_: dict[str, list[int]] = {}
    pairs: dict[int, int] = {}
    for k, (_, _, ends, name, attributes) in enumerate(tokens):
        if name in DROPPED:
            if not ends:
                if not attributes.rstrip().endswith("/"):
                    open_.setdefault(name, []).append(k)
            elif open_.get(name):
                pairs[open_[name].pop()] = k
    return pairs


def leaf_blocks(page: str) -> list[Block]:
    """(features of the open elements, text, share of the text in links) of each leaf block with text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked = total = 0
    chain: tuple[str, ...] | None = ()

    def flush() -> None:
        nonlocal linked, total, chain
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                if chain is None:
                    chain = tuple(x for _, names in stack[-ANCESTORS:] for x in names)
                out.append((chain, text, linked / max(1, total)))
            parts.clear()
            linked = total = 0

    def cut(k: int) -> None:
        nonlocal chain
        for name, _ in stack[k:]:
            open_[name] -= 1
        del stack[k:]
        chain = None

    def add(a: int, b: int) -> None:
        nonlocal linked, total
        if b > a:
            parts.append(page[a:b])
            total += b - a
            linked += (b - a) * (open_["a"] > 0)

    tokens = tags(page)
    skip, at, k = dropped(tokens), 0, 0
    while k < len(tokens):
        start, end, ends, name, attributes = tokens[k]
        add(at, start)
        at = end
        if not ends and k in skip:
            parts.append(" ")
            k = skip[k]
            at = tokens[k][1]
            k += 1
            continue
        k += 1
        if not name or name in RAW or name in DROPPED:
            if name in RAW and not ends:
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name not in INLINE
        if block:
            flush()
        near = range(len(stack) - 1, max(-1, len(stack) - 1 - REACH), -1)
        if ends:
            if open_[name]:
                for i in near if not block else range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        cut(i)
                        break
                    if not block and stack[i][0] not in INLINE:
                        break
        elif name not in VOID:
            closes = {"p"} if name in CLOSES_P else SIBLINGS.get(name)
            if closes and any(open_[x] for x in closes):
                for i in near:
                    if stack[i][0] in closes:
                        cut(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "article", "section", "div", "body", "td", "blockquote"):
                        break
            own: tuple[str, ...] = ()
            if block:
                own = tuple(sorted({f"tag:{name}"} | {f"name:{w}" for x in NAMED.finditer(attributes) for w in re.split(r"[^a-z]+", (x[1] or x[2] or x[3] or "").lower()) if w}))
            stack.append((name, own))
            open_[name] += 1
            if own:
                chain = None
    add(at, len(page))
    flush()
    return out


def text_features(text: str, link_share: float) -> list[str]:
    words = text.count(" ") + 1
    size = 0 if words < 4 else 1 if words < 12 else 2 if words < 40 else 3
    return [f"words:{size}", f"links:{int(min(link_share, 0.99) * 3)}", f"stop:{text[-1] in '.!?'}", f"mark:{text[0] in '©®|»'}"]


class Field:
    """Weights of the difference between main text (1) and the rest (0), and the scores of steps between labels."""

    def __init__(self, weights: dict[str, float], start: float, steps: tuple[float, float, float, float]):
        self.weights, self.start, self.steps, self.known = weights, start, steps, {}

    def scores(self, blocks: list[Block]) -> list[float]:
        get, known, out = self.weights.get, self.known, []
        for chain, text, share in blocks:
            if (s := known.get(chain)) is None:
                if len(known) > 50_000:
                    known.clear()
                s = known[chain] = get("bias", 0.0) + sum(get(x, 0.0) for x in set(chain))
            out.append(s + sum(get(x, 0.0) for x in text_features(text, share)))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The labels of the best path (Viterbi)."""
        if not blocks:
            return []
        s00, s01, s10, s11 = self.steps
        scores = self.scores(blocks)
        best0, best1, back = 0.0, scores[0] + self.start, []
        for s in scores[1:]:
            from0, from1 = best1 + s10 > best0 + s00, best1 + s11 >= best0 + s01
            back.append((from0, from1))
            best0, best1 = (best1 + s10 if from0 else best0 + s00), (best1 + s11 if from1 else best0 + s01) + s
        label, path = best1 > best0, [best1 > best0]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n\n".join(b[1] for b, main in zip(blocks, self.decode(blocks), strict=True) if main)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 300, rate: float = 0.2, decay: float = 1e-3, least: int = 2) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam over all pages at once."""
    feats = [[{"bias", *chain, *text_features(t, s)} for chain, t, s in blocks] for blocks, _ in pages]
    counts = Counter(f for page in feats for block in page for f in block)
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    n, longest = len(pages), max(len(p) for p in feats)
    rows, cols = [], []
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest))
    for i, (page, (_, labels)) in enumerate(zip(feats, pages, strict=True)):
        mask[i, : len(page)], gold[i, : len(page)] = True, labels
        for j, block in enumerate(page):
            for f in block & index.keys():
                rows.append(i * longest + j)
                cols.append(index[f])
    rows, cols = np.array(rows), np.array(cols)
    w = np.zeros(len(index) + 5)  # features, start, steps 00 01 10 11
    m, v = np.zeros_like(w), np.zeros_like(w)
    both = mask[:, 1:] & mask[:, :-1]
    for t in range(1, rounds + 1):
        score = np.bincount(rows, weights=w[cols], minlength=n * longest).reshape(n, longest)
        step = w[-4:].reshape(2, 2)
        emit = np.stack([np.zeros_like(score), score], -1)
        emit[:, 0, 1] += w[-5]
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for j in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, j - 1, :, None] + step, axis=1) + emit[:, j]
            ahead[:, j] = np.where(mask[:, j, None], new, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(step + (emit[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(both[:, j, None], new, 0)
        z = np.logaddexp.reduce(ahead[:, -1], axis=1)
        one = np.where(mask, np.exp(ahead[..., 1] + behind[..., 1] - z[:, None]), 0)
        pair = np.exp(ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        pairs = pair.sum((0, 1))
        was = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
        off = (one - gold * mask).ravel()
        grad = np.concatenate([np.bincount(cols, weights=off[rows], minlength=len(index)), [(one - gold)[:, 0].sum()], (pairs - was).ravel()]) / n + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field({f: float(w[i]) for f, i in index.items()}, float(w[-5]), tuple(float(x) for x in w[-4:]))


def labelled_pages(n: int = 480, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """Pages of many layouts written from a rule; the text of main blocks begins with a mark, which is taken off again."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        text = " ".join("".join(rng.choice(["an", "el", "or", "ti", "ma", "su", "ré", "ün", "ko", "da"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))
        return text.capitalize() + rng.choice([".", ".", ".", "", "!"])

    def prose() -> str:
        return words(*rng.choice([(1, 3), (5, 20), (20, 60), (40, 120)]))

    def main(tag: str, text: str) -> str:
        inner = rng.choice(["{}", "{}", "<b>{}</b>", "<b>{}<br>", "<em>{}</em> " + words(2, 6), "{} <a href='/x'>" + words(1, 3) + "</a>"]).format("\x01" + text)
        return f"<{tag}>{inner}" + rng.choice([f"</{tag}>", f"</{tag}>", "" if tag == "p" else f"</{tag}>"])

    def listed(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(k)) + "</ul>"

    def body() -> str:
        out = [main("h1", words(3, 9))] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.75:
                out.append(main("p", prose()))
            elif kind < 0.82:
                out.append(main(rng.choice(["h2", "h3"]), words(2, 6)))
            elif kind < 0.88:
                out.append("<ul>" + "".join(main("li", words(2, 20)) for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.92:
                out.append("<blockquote>" + main("p", prose()) + "</blockquote>")
            elif kind < 0.96:
                out.append("<table><tr>" + "".join(main("td", words(1, 4)) for _ in range(3)) + "</tr></table>")
            else:
                out.append(main("pre", words(3, 20)))
            if rng.random() < 0.08:
                out.append(junk(rng.choice(["ad", "advert", "promo", "newsletter", "share", "related"])))
        return "".join(out)

    def junk(name: str) -> str:
        tag = rng.choice(["div", "div", "aside", "section"])
        return f'<{tag} class="{name}">' + rng.choice([words(3, 15), f"<p>{prose()}</p>", listed(3), f"<p>{prose()}</p><p>{prose()}</p>"]) + f"</{tag}>"

    def strange() -> str:
        """A container whose names say nothing, since no two pages share them."""
        name = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5)))
        tag = rng.choice(["div", "div", "div", "section", "td", "span"])
        mark = rng.choice([f' id="{name}"', f' class="{name} {name[::-1]}"', ""])
        inner = f"<{tag}{mark}>{{}}</{tag}>".replace("span", "div")
        return f"<table><tr>{inner}</tr></table>" if tag == "td" else inner

    def strange_junk() -> str:
        """What isn't main text, in a container without a telling name: links, or a few words."""
        return strange().format(rng.choice([listed(rng.randint(3, 8)), " | ".join(f'<a href="/{k}">{words(1, 2)}</a>' for k in range(rng.randint(3, 8))), f"<p>{'&copy; ' if rng.random() < 0.5 else ''}{words(1, 5)}</p>", f'<p><a href="/x">{words(2, 12)}</a></p>']))

    out = []
    for _ in range(n):
        known = ["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div id="content">{}</div>', '<div class="post article-body">{}</div>', '<div class="entry-content">{}</div>']
        where, kind = rng.choice(known), rng.random()
        if kind < 0.45:  # the container is unfamiliar, or there is none
            where = strange() if kind < 0.38 else "{}"
        front = [f"<nav>{listed(rng.randint(2, 7))}</nav>", f"<header>{rng.choice([f'<h1>{words(1, 4)}</h1>', f'<p>{words(2, 9)}</p>', listed(4)])}</header>", junk(rng.choice(["ad", "ads", "banner", "cookie notice", "notice", "menu", "navbar", "breadcrumb", "advertisement"])), f"<form><label>{words(1, 3)}</label><p>{words(1, 8)}</p></form>"]
        back = [f"<footer>{rng.choice(['&copy; ', ''])}{words(2, 40)}</footer>", junk(rng.choice(["sidebar", "widget", "related", "ad", "newsletter", "footer", "subscribe", "cookie consent"])), '<section id="comments" class="comments"><h3>Comments</h3>' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>", f"<aside>{rng.choice([listed(3), f'<p>{prose()}</p>'])}</aside>", f"<nav>{listed(3)}</nav>"]
        if rng.random() < 0.3:
            front.append(strange_junk())
            back.append(strange_junk())
        head = f"<html><head><title>{words(3, 9)}</title></head><body>" if rng.random() < 0.9 else ""
        inner = "".join(rng.sample(front, rng.randint(0, 4))) + where.format(body()) + "".join(rng.sample(back, rng.randint(0, min(5, len(back)))))
        page = head + (strange().format(inner) if rng.random() < 0.3 else inner)
        blocks = leaf_blocks(page)
        if blocks:
            out.append(([(c, t.replace("\x01", "") or ".", s) for c, t, s in blocks], ["\x01" in t for _, t, _ in blocks]))
    return out


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    given = field or default_field()
    held = pages.sparkSession.sparkContext.broadcast((given.weights, given.start, given.steps))  # as many weights as the training pages have features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*held.value)
        for part in slices(batches):
            texts = [own.main_text(page) for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pick(pages, page_id="page_id", url="url", html="html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
