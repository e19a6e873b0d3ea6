"""Main-text extraction from HTML with gradient-boosted trees over DOM nodes.

Each element and text run of a page is a node with features: its tag and its ancestors',
tokens of class, id and role, depth, subtree text length and density, link share,
punctuation, position and sibling statistics. Boosted trees (Spark ML) give each node
the probability that main text lies in it. Decoding then picks, over the whole tree, the
most probable labelling in which a node outside the main text has no descendant inside
it, so choices of ancestors and descendants never contradict each other.

Training pages are a bounded sample (about ``TRAIN_PAGES`` pages, picked by a hash of their
id, whole): the pages themselves, labelled by their semantic elements where they have such, and the same paragraphs set again in ``LAYOUTS`` random layouts each
(with menus, page headers, footers, sidebars, notices, adverts, forms and reader
comments), where the truth is known by construction. Pages are extracted whole.

Edge cases: null, empty or text-free html gives the empty text; text outside any element
is a node of its own; unclosed and misnested tags are closed where HTML implies it;
scripts, styles, comments and head matter are never text; repeated rows get equal
answers; further columns are ignored.
"""

from __future__ import annotations

import html
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import N_FEATURES, Page
from .shared import bounded_sample, materialize

TRAIN_PAGES, LAYOUTS = 200, 4
TREES, DEPTH = 20, 5
PAGES_AT_ONCE = 200


@dataclass
class Model:
    """Boosted trees as arrays: feature (-1: leaf), threshold, children and value of each tree node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
            total += self.value[at]
        return total


def _teacher(page: Page) -> list[int] | None:
    """Labels of a page's nodes by its semantic elements; None if it has no article or main."""
    main = [False] * len(page.tag)
    out = [False] * len(page.tag)
    found = False
    for i in range(1, len(page.tag)):
        p = page.parent[i]
        tag = page.tag[i]
        here = tag in ("article", "main")
        found |= here
        aside = tag in ("nav", "aside", "footer", "form") or (tag == "header" and not main[p]) or page.tokens[i] & 0b110011110 and not here
        out[i] = out[p] or bool(aside)
        main[i] = (main[p] or here) and not out[i]
    return _upward(page, [int(bool(page.text[i]) and main[i]) for i in range(len(page.tag))]) if found else None


def _upward(page: Page, leaf: list[int]) -> list[int]:
    label = list(leaf)
    for i in range(len(label) - 1, 0, -1):
        if label[i]:
            label[page.parent[i]] = 1
    return label


def _layout(rng: random.Random, title: str, paragraphs: list[str]) -> tuple[str, list[int]]:
    """A page with the given main text in a random layout, and the label of each text run in order."""
    labels: list[int] = []
    pick = rng.choice

    def text(s: str, y: int) -> str:
        labels.append(y)
        return html.escape(s, quote=False)

    def snippet(lo: int, hi: int) -> str:
        words = pick(paragraphs).split() or ["x"]
        k = rng.randrange(len(words))
        return " ".join((words[k:] + words)[: rng.randint(lo, hi)])

    def named(*names: str) -> str:
        return rng.choice(["", f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{pick(names)} {pick(["wide", "box", "x1", "row"])}"'])

    def sure(*names: str) -> str:
        return rng.choice([f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{pick(names)} {pick(["wide", "box", "x1"])}"'])

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{text(snippet(1, 3), 0)}</a></li>' for k in range(n)) + "</ul>"

    def prose(n: int, lo: int = 4, hi: int = 30) -> str:
        return "".join(f"<p>{text(snippet(lo, hi), 0)}</p>" for _ in range(n))

    def nav() -> str:
        if rng.random() < 0.5:
            return f"<nav{named('nav', 'menu', 'navbar')}>{links(rng.randint(2, 8))}</nav>"
        return f"<div{sure('nav', 'menu', 'navigation', 'breadcrumb', 'navbar')}>{links(rng.randint(2, 8))}</div>"

    def header() -> str:
        inner = f"<a href='/'>{text(snippet(1, 3), 0)}</a>" + (nav() if rng.random() < 0.5 else "") + (prose(1, 2, 8) if rng.random() < 0.5 else "")
        return f"<header{named('header', 'masthead', 'site-header')}>{inner}</header>" if rng.random() < 0.6 else f"<div{sure('header', 'masthead', 'topbar', 'site-header')}>{inner}</div>"

    def footer() -> str:
        inner = text("© " + snippet(2, 14), 0) if rng.random() < 0.5 else prose(rng.randint(1, 2)) + (links(3) if rng.random() < 0.5 else "")
        return f"<footer{named('footer')}>{inner}</footer>" if rng.random() < 0.6 else f"<div{sure('footer', 'foot', 'site-footer', 'copyright')}>{inner}</div>"

    def advert() -> str:
        tag = pick(["div", "aside", "section"])
        inner = text(snippet(3, 25), 0) if rng.random() < 0.6 else prose(1)
        return f"<{tag}{sure('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-banner')}>{inner}</{tag}>"

    def sidebar() -> str:
        inner = f"<h3>{text(snippet(1, 3), 0)}</h3>" + (links(rng.randint(2, 6)) if rng.random() < 0.6 else prose(rng.randint(1, 3)))
        return f"<aside{named('sidebar', 'related', 'widget')}>{inner}</aside>" if rng.random() < 0.5 else f"<div{sure('sidebar', 'related', 'widget', 'side')}>{inner}</div>"

    def notice() -> str:
        inner = (prose(1, 4, 30) if rng.random() < 0.5 else text(snippet(4, 25), 0)) + (f"<button>{text('OK', 0)}</button>" if rng.random() < 0.5 else "")
        return f"<div{sure('cookie-notice', 'notice', 'consent', 'alert', 'newsletter', 'cookie', 'popup')}>{inner}</div>"

    def form() -> str:
        return f"<form{named('search', 'login', 'signup', 'contact')}><label>{text(snippet(1, 4), 0)}</label><input name='q'><button>{text(snippet(1, 2), 0)}</button></form>"

    def comments() -> str:
        tag = pick(["section", "div"])
        one = lambda: f"<{pick(['div', 'article', 'li'])}{sure('comment', 'reply')}><b>{text(snippet(1, 2), 0)}</b>{prose(rng.randint(1, 2), 5, 60)}</div>"
        return f"<{tag}{sure('comments', 'comment-list', 'discussion', 'responses comments', 'reader-comments')}><h3>{text(snippet(1, 3), 0)}</h3>{''.join(one() for _ in range(rng.randint(1, 4)))}</{tag}>"

    inside = [advert, notice, form, sidebar, comments]
    parts: list[str] = []
    for make, chance in ((notice, 0.3), (header, 0.5), (nav, 0.6), (advert, 0.4), (sidebar, 0.25), (form, 0.25)):
        if rng.random() < chance:
            parts.append(make())
    body = []
    if rng.random() < 0.8:
        h = f"<h1>{text(title, 1)}</h1>"
        body.append(f"<header>{h}</header>" if rng.random() < 0.15 else h)
    for k, p in enumerate(paragraphs):
        style = rng.random()
        if style < 0.75:
            body.append(f"<p>{text(p, 1)}</p>" if rng.random() < 0.8 else f"<p><b>{text(p, 1)}<br>")
        elif style < 0.83:
            body.append(f"<h2>{text(snippet(2, 6), 1)}</h2><p>{text(p, 1)}</p>")
        elif style < 0.9:
            body.append(f"<ul><li>{text(p, 1)}</li><li>{text(snippet(3, 20), 1)}</li></ul>")
        elif style < 0.95:
            body.append(f"<blockquote>{text(p, 1)}</blockquote>")
        else:
            body.append(f"<div>{text(p, 1)}</div>")
        if k + 1 < len(paragraphs) and rng.random() < 0.12:
            body.append(pick(inside)())
    if rng.random() < 0.25:
        body.append(pick(inside)())
    open_, close = pick([
        ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{sure('content', 'post', 'entry', 'article', 'story', 'main')}>", "</div>"),
        (f"<section{named('content', 'post')}>", "</section>"), ("<div><div>", "</div></div>"),
    ])
    parts.append(open_ + "".join(body) + close)
    for make, chance in ((comments, 0.4), (sidebar, 0.3), (advert, 0.3), (form, 0.2), (notice, 0.15), (footer, 0.8)):
        if rng.random() < chance:
            parts.append(make())
    wrap = ("<div id='page'>", "</div>") if rng.random() < 0.3 else ("", "")
    return f"<html><head><title>{html.escape(title)}</title></head><body>{wrap[0]}{''.join(parts)}{wrap[1]}</body></html>", labels


def _training_rows(source: str, seed: int):
    """(features, labels) of a page and of its new layouts."""
    page = Page(source)
    taught = _teacher(page)
    if taught:
        yield page.features(), np.array(taught)
    good = [page.text[i] for i in range(len(page.tag)) if page.text[i] and (taught[i] if taught else len(page.text[i]) > 40)]
    good = [" ".join(html.unescape(x).split()) for x in good]
    good = [x for x in good if x][:30]
    if not good:
        return
    rng = random.Random(seed)
    for _ in range(LAYOUTS):
        some = [rng.choice(good) for _ in range(rng.randint(1, 8))]
        made, labels = _layout(rng, " ".join(some[0].split()[:9]), some)
        fresh = Page(made)
        leaf, k = [0] * len(fresh.tag), 0
        for i, t in enumerate(fresh.text):
            if t:
                leaf[i] = labels[k] if k < len(labels) else 0
                k += 1
        if k == len(labels):
            yield fresh.features(), np.array(_upward(fresh, leaf))


def train(pages: DataFrame) -> Model | None:
    """Boosted trees over the nodes of a bounded sample of pages; None if it has no text."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("html is not null")
    sample = bounded_sample(source, "page_id", TRAIN_PAGES)

    def run(batches):
        for batch in batches:
            for page_id, s in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for x, y in _training_rows(s, page_id or 0):
                    yield pa.record_batch([pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.ravel().astype(float))), pa.array(y.astype(float))], names=["x", "label"])

    rows = materialize(sample.mapInArrow(run, "x array<double>, label double"), "dom-nodes")
    if rows.where("label = 1").isEmpty() or rows.where("label = 0").isEmpty():
        return None
    fitted = GBTClassifier(featuresCol="v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1).fit(
        rows.coalesce(4).select(array_to_vector("x").alias("v"), "label")
    )
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(node, weight: float) -> int:
        at = len(feature)
        for column, empty in ((feature, -1), (threshold, 0.0), (left, at), (right, at), (value, 0.0)):
            column.append(empty)
        if node.subtreeDepth() == 0:
            value[at] = node.prediction() * weight
        else:
            feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
            left[at], right[at] = add(node.leftChild(), weight), add(node.rightChild(), weight)
        return at

    for tree, weight in zip(fitted.trees, fitted.treeWeights, strict=True):
        roots.append(add(tree._call_java("rootNode"), weight))
    return Model(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), roots)


def decode(page: Page, inside: list[float], outside: list[float]) -> list[bool]:
    """The most probable labelling in which nothing inside stands below something outside.

    ``inside`` and ``outside`` are the log probabilities of each node's two labels.
    """
    n = len(page.tag)
    drop, gain = list(outside), list(inside)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        drop[p] += drop[i]
        gain[p] += gain[i] if gain[i] > drop[i] else drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and gain[i] > drop[i]
    return kept


def extract(pages: DataFrame, model: Model | None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row. Without a model all text is kept."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                rows = batch.slice(lo, PAGES_AT_ONCE)
                read = [Page(s) for s in rows.column("html").to_pylist()]
                sizes = [len(p.tag) for p in read]
                if m is not None:
                    margin = 2 * m.margin(np.concatenate([p.features() for p in read]))
                    inside, outside = (-np.logaddexp(0, -margin)).tolist(), (-np.logaddexp(0, margin)).tolist()
                texts, at = [], 0
                for page, n in zip(read, sizes, strict=True):
                    kept = decode(page, inside[at : at + n], outside[at : at + n]) if m is not None else [True] * n
                    texts.append(page.blocks(kept))
                    at += n
                yield pa.record_batch([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    """Train on a sample of ``pages`` and extract every page."""
    return extract(pages, train(pages))
