"""Main text of web pages: gradient-boosted trees over DOM nodes, then one consistent choice for the whole tree.

Every element and every text run is a node. Trees score each node by its subtree's text, link, tag and punctuation densities, its
attribute words, depth, place and siblings, and what stands around it. A node's margin speaks for keeping it; the
decoding takes the set of nodes with the largest sum of margins in which nothing is kept inside something dropped, so
an advert inside an article goes while the article stays. What is never drawn (scripts, styles, the head) is no candidate.

The trees are trained here, by Spark, on a bounded sample: about ``TRAIN_PAGES`` different pages, chosen by their hash, and at
most ``TRAIN_CHARS`` characters of each. A page is used as it is, with labels from its own article element, and its
sentences are set again into page layouts with known parts: with and without telling tags, with menus, adverts,
notices, forms and reader comments around and inside the article, and with tags left open.

Defined cases: a null or empty page has empty text; a page without an article gives what the trees take for one, maybe
nothing; tags that are not closed end with their parent; nesting may be of any depth; repeated rows are extracted one by one; a page of any
length is read in one walk, and close tags that end nothing cost nothing; no pages give no rows;
columns named ``text`` and ``n_chars`` in the input are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenfile import sampled
from .dom import BAD_TAGS, BAD_WORDS, FEATURES, GOOD_TAGS, Page

#: Parameters: bounds of the training sample, layouts per page, and the trees.
TRAIN_PAGES = 200
TRAIN_CHARS = 20_000
LAYOUTS = 2
TREES, TREE_DEPTH, STEP, SEED = 15, 5, 0.3, 7


def _labels(page: Page, wanted: list[bool]) -> list[bool]:
    """A node is kept if it is wanted text or has some inside."""
    out = list(wanted)
    for k in range(len(out) - 1, 0, -1):
        out[page.parent[k]] = out[page.parent[k]] or out[k]
    return out


def labels_by_tags(page: Page) -> list[bool] | None:
    """Labels of a page that marks its article by a tag: its text, but nothing in parts with telling names."""
    if not GOOD_TAGS & set(page.tag):
        return None
    inside, wanted, seen = [False], [False], page.seen()
    for k in range(1, len(page.parent)):
        bad = page.tag[k] in BAD_TAGS or any(w in BAD_WORDS for w in page.words[k])
        inside.append((inside[page.parent[k]] or page.tag[k] in GOOD_TAGS) and not bad and seen[k])
        wanted.append(inside[k] and page.tag[k] == "#text")
    return _labels(page, wanted)


class _Layout:
    """A page with the given sentences in known parts; wanted text starts with a mark that is taken out again."""

    MARK = "\u0001"

    def __init__(self, sentences: list[str], seed: int):
        self.random = random.Random(seed)
        self.sentences = sentences or ["Empty."]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.random.choice(self.sentences) for _ in range(self.random.randint(low, high)))

    def box(self, words: list[str], inside: str, tags=("div", "section")) -> str:
        tag, word = self.random.choice(tags), self.random.choice(words)
        name = self.random.choice(["class", "id"])
        telling = f' {name}="{word}"' if tag in ("div", "section", "ul", "ol", "p") or self.random.random() < 0.3 else ""
        return f"<{tag}{telling}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/{k}">{escape(self.some(1, 1)[:20])}</a></li>' for k in range(self.random.randint(low, high))]
        return f"<ul>{''.join(items)}</ul>"

    def part(self, kind: str) -> str:
        short, long = escape(self.some(1, 2)), escape(self.some(1, 5))
        return {
            "menu": lambda: self.box(["menu", "nav", "navbar", "main-menu", "navigation"], self.links(3, 9), ("nav", "nav", "div")),
            "header": lambda: self.box(["header", "masthead", "site-header"], f"<h1>{short[:30]}</h1><p>{short}</p>", ("header", "div")),
            "footer": lambda: self.box(["footer", "site-footer", "copyright"], f"&copy; {short}" + self.random.choice(["", self.links(1, 4)]), ("footer", "footer", "div")),
            "sidebar": lambda: self.box(["sidebar", "widget", "related"], f"<h3>{short[:20]}</h3>{self.links(2, 6)}<p>{short}</p>", ("aside", "aside", "div")),
            "advert": lambda: self.box(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], self.random.choice([short, long, f"<p>{short}</p>"]), ("div", "div", "aside")),
            "notice": lambda: self.box(["notice", "cookie-notice", "consent", "alert", "popup"], f"<p>{short}</p><button>{short[:9]}</button>"),
            "form": lambda: f"<form action='/s'><label>{short[:25]}</label><input name=q><p>{short}</p><button>{short[:8]}</button></form>",
            "share": lambda: self.box(["share", "social", "toolbar"], self.links(2, 4)),
            "comments": lambda: self.box(
                ["comments", "comment-list", "replies", "reader-comments"],
                f"<h3>{short[:15]}</h3>" + "".join(f"<div class='comment'><b>{short[:9]}</b><p>{escape(self.some(1, 4))}</p></div>" for _ in range(self.random.randint(1, 5))),
                ("div", "section", "ol", "aside"),
            ),
        }[kind]()

    def paragraph(self) -> str:
        text = self.MARK + escape(self.some(1, 8))
        return self.random.choice(
            [f"<p>{text}</p>"] * 5 + [f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <i>{self.MARK}{escape(self.some(1, 1))}</i></p>", f"<h2>{text[:40]}</h2>", f"<ul><li>{text}</li><li>{text}</li></ul>", f"<blockquote>{text}</blockquote>", f"<div>{text}</div>"]
        )

    def html(self) -> str:
        choose, pick = self.random.random, self.random.choice
        blocks = [f"<h1>{self.MARK}{escape(self.some(1, 1))[:60]}</h1>"] if choose() < 0.8 else []
        blocks += [self.paragraph() for _ in range(self.random.randint(1, 9))]
        for kind in ("advert", "share", "form", "sidebar", "notice", "comments"):
            if choose() < 0.15:
                blocks.insert(self.random.randint(1, len(blocks)), self.part(kind))
        article = pick(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="post-body">{}</div>', '<div class="entry">{}</div>', "<div>{}</div>", '<article class="post">{}</article>'])
        before = [self.part(k) for k in ("header", "menu", "notice", "advert", "form") if choose() < 0.5]
        after = [self.part(k) for k in ("comments", "sidebar", "advert", "share", "form", "footer") if choose() < 0.5]
        self.random.shuffle(before)
        return f"<html><head><title>{escape(self.some(1, 1))}</title></head><body>{''.join(before)}{article.format(''.join(blocks))}{''.join(after)}</body></html>"

    def page(self) -> tuple[Page, list[bool]]:
        page = Page(self.html())
        wanted = [text.startswith(self.MARK) for text in page.text]
        page.text = [text.removeprefix(self.MARK) for text in page.text]
        return page, _labels(page, wanted)


def training_rows(htmls: list[str]) -> pd.DataFrame:
    """Features and labels of the nodes of all training pages."""
    features, labels = [], []
    for k, html in enumerate(htmls):
        own = Page(html)
        made = [(own, labels_by_tags(own))]
        sentences = [" ".join(t.split())[:400] for t in own.text if len(t.split()) > 2]
        made += [_Layout(sentences, SEED + LAYOUTS * k + j).page() for j in range(LAYOUTS)]
        for page, label in made:
            if label is not None:
                seen = np.array(page.seen())
                features.append(page.features()[seen])
                labels.append(np.array(label, np.float64)[seen])
    if not features:
        features, labels = [np.zeros((0, len(FEATURES)), np.float32)], [np.zeros(0)]
    frame = pd.DataFrame(np.concatenate(features).astype(np.float64), columns=list(FEATURES))
    frame["label"] = np.concatenate(labels)
    return frame


class Forest:
    """Boosted trees as arrays: feature (-1 in a leaf), threshold, left child, value; the right child follows the left."""

    def __init__(self, trees: list[list[tuple[int, float, int, float]]], weights: list[float]):
        self.trees = [tuple(np.array(c) for c in zip(*tree)) for tree in trees]
        self.weights = weights

    @staticmethod
    def of(model) -> Forest:
        trees = []
        for tree in model.trees:
            nodes, waiting = [None], [(0, tree._java_obj.rootNode())]
            while waiting:
                at, node = waiting.pop()
                if node.subtreeDepth() == 0:
                    nodes[at] = (-1, 0.0, 0, float(node.prediction()))
                    continue
                split = node.split()
                nodes[at] = (int(split.featureIndex()), float(split.threshold()), len(nodes), 0.0)
                waiting += [(len(nodes), node.leftChild()), (len(nodes) + 1, node.rightChild())]
                nodes += [None, None]
            trees.append(nodes)
        return Forest(trees, [float(w) for w in model.treeWeights])

    def margins(self, features: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(features)), np.arange(len(features))
        for (feature, threshold, left, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(features), np.int64)
            for _ in range(TREE_DEPTH):
                f = feature[at]
                right = features[rows, np.maximum(f, 0)] > threshold[at]
                at = np.where(f < 0, at, left[at] + right)
            out += weight * value[at]
        return out


def train(pages: DataFrame) -> Forest:
    """Trees from the bounded sample of pages; without any page every node is kept."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    drawn = sampled(pages.select("page_id", "html"), TRAIN_PAGES)
    chosen = drawn.select("page_id", F.substring("html", 1, TRAIN_CHARS).alias("html")).filter("length(html) > 0")
    rows = sorted(chosen.distinct().collect(), key=lambda r: (r.page_id is None, r.page_id, r.html))
    known = training_rows([r.html for r in rows])
    if known["label"].nunique() < 2:
        return Forest([[(-1, 0.0, 0, 1.0)]], [1.0])
    nodes = pages.sparkSession.createDataFrame(known).repartition(4)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(nodes).select("features", "label")
    boosted = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=STEP, seed=SEED, maxBins=64)
    return Forest.of(boosted.fit(table))


def _extracted(htmls: list[str | None], forest: Forest) -> list[str]:
    pages = [Page(html or "") for html in htmls]
    features = [page.features() for page in pages]
    margins = np.split(forest.margins(np.concatenate(features)), np.cumsum([len(f) for f in features])[:-1])
    return [page.main_text(page.consistent(m)) for page, m in zip(pages, margins)]


def extract(pages: DataFrame, forest: Forest) -> DataFrame:
    """``pages`` without ``html``, with the main ``text`` and its length in code points."""
    pages = pages.drop("text", "n_chars")
    names = [c for c in pages.columns if c != "html"]
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = _extracted(part.column("html").to_pylist(), forest)
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made], [*names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages.select("page_id", "html")))
