"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a variable: main text or not. Node potentials come from its tag, its names (class, id, role),
its text and links; parent-child potentials say how labels go together along the tree. Messages are passed upward and
downward once (sum-product), which gives each node's exact marginal; text of nodes with a marginal of at
least ``threshold`` is kept, in page order. Weights are fitted by gradient steps on the likelihood of labelled pages,
with expectations from the same messages, on the driver: the pages are a fixed, small set.

Pages are worked on in place, each whole, without a shuffle.

Defined cases: a null page counts as empty and has the empty text; text outside any element belongs to the page
node; a page without markup is judged like any node; an empty table gives an empty result; repeated rows each
get their text. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import lean, ship
from sieve.llm.dom import Node, Page, read_page
from sieve.llm.labelled_pages import labelled_pages

# Words in names that speak for or against main text, and groups of tags.
FOR = frozenset("article content post entry story main body text".split())
AGAINST = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal "
    "sidebar side widget related recommended trending popular menu nav navigation navbar breadcrumb breadcrumbs topbar links tags share sharing "
    "social footer header masthead newsletter subscribe signup login search pagination copyright toolbar".split()
)
SPEAKS = frozenset("comment comments reply replies respond responses discussion disqus".split())
GROUPS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "body": "top", "html": "top", "#page": "top",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "ul": "list", "ol": "list", "li": "list", "dl": "list", "dt": "list", "dd": "list",
    "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "table", "th": "table",
    "pre": "quote", "blockquote": "quote", "figure": "quote", "figcaption": "quote",
    "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "head": "head",
    "form": "form", "button": "form", "select": "form", "option": "form", "fieldset": "form", "legend": "form", "dialog": "form",
}
GROUP_NAMES = sorted(set(GROUPS.values()) | {"other"})
OTHERS = ("bias", "for", "against", "speaks", "log_words", "links", "short", "no_text", "sentences", "sign", "share_below", "container_share")
FEATURES = tuple(f"tag_{g}" for g in GROUP_NAMES) + tuple(f"under_{g}" for g in GROUP_NAMES) + OTHERS
_place = {name: k for k, name in enumerate(FEATURES)}


def node_features(node: Node, total: int) -> list[tuple[int, float]]:
    names = node.names()
    group = GROUPS.get(node.tag, "other")
    out = [(_place["bias"], 1.0), (_place[f"tag_{group}"], 1.0)]
    if names & AGAINST:
        out.append((_place["against"], 1.0))
    elif names & FOR:
        out.append((_place["for"], 1.0))
    if names & SPEAKS:
        out.append((_place["speaks"], 1.0))
    if node.words:
        out.append((_place["log_words"], math.log1p(min(node.words, 400)) / 6))
        out.append((_place["links"], node.link_words / node.words))
        if node.words < 5:
            out.append((_place["short"], 1.0))
        out.append((_place["sentences"], min(node.sentences, 4) / 4))
    else:
        out.append((_place["no_text"], 1.0))
    if node.sign:
        out.append((_place["sign"], 1.0))
    share = node.below / total if total else 0.0
    out.append((_place["share_below"], share))
    if group in ("article", "main", "section", "div", "other"):
        out.append((_place["container_share"], share))
    return out


def page_features(page: Page) -> list[list[tuple[int, float]]]:
    nodes = page.nodes
    total = nodes[0].below + nodes[0].words
    out = []
    for node in nodes:
        own = node_features(node, total)
        if node.parent >= 0:
            own.append((_place[f"under_{GROUPS.get(nodes[node.parent].tag, 'other')}"], 1.0))
        out.append(own)
    return out


def potentials(page: Page, weights: list[float]) -> list[float]:
    return [sum(weights[k] * v for k, v in own) for own in page_features(page)]


def infer(page: Page, scores: list[float], edges) -> tuple[list[float], list[tuple]]:
    """Marginals of label 1 by sum-product, and for each node below the page the joint of (parent, child) labels."""
    nodes = page.nodes
    up: list[list[float]] = []
    for s in scores:
        one = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
        up.append([1 - one, one])
    e00, e01, e10, e11 = map(math.exp, edges)
    to_parent: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        a, b = up[k]
        m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
        norm = m0 + m1
        to_parent[k] = m0, m1 = m0 / norm, m1 / norm
        parent = up[nodes[k].parent]
        parent[0] *= m0
        parent[1] *= m1
        norm = parent[0] + parent[1]
        parent[0] /= norm
        parent[1] /= norm
    # up[k] holds the node and all below it; going down, `outer` is what the rest of the tree says.
    outer: list[tuple[float, float]] = [(0.5, 0.5)] * len(nodes)
    marginals, joints = [0.0] * len(nodes), [()] * len(nodes)
    for k, node in enumerate(nodes):
        if k:
            p = node.parent
            m0, m1 = to_parent[k]
            q0, q1 = outer[p][0] * up[p][0] / m0, outer[p][1] * up[p][1] / m1
            a, b = up[k]
            j00, j01, j10, j11 = q0 * e00 * a, q0 * e01 * b, q1 * e10 * a, q1 * e11 * b
            norm = j00 + j01 + j10 + j11
            joints[k] = (j00 / norm, j01 / norm, j10 / norm, j11 / norm)
            o0, o1 = q0 * e00 + q1 * e10, q0 * e01 + q1 * e11
            outer[k] = (o0 / (o0 + o1), o1 / (o0 + o1))
        b0, b1 = up[k][0] * outer[k][0], up[k][1] * outer[k][1]
        marginals[k] = b1 / (b0 + b1)
    return marginals, joints


def _labels(page: Page) -> list[int]:
    out: list[int] = []
    for node in page.nodes:
        own = 1 if 'data-main="1"' in node.attributes else 0 if 'data-main="0"' in node.attributes else None
        out.append(own if own is not None else out[node.parent] if node.parent >= 0 else 0)
    return out


@lru_cache(maxsize=4)
def trained(pages: int = 240, steps: int = 240, rate: float = 0.3, penalty: float = 1e-4) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Node weights and edge potentials from labelled pages, by Adam on the penalised log likelihood."""
    read = [read_page(p) for p in labelled_pages(pages)]
    labels = [np.array(_labels(p)) for p in read]
    features = []
    for page in read:
        f = np.zeros((len(page.nodes), len(FEATURES)))
        for k, own in enumerate(page_features(page)):
            for place, v in own:
                f[k, place] += v
        features.append(f)
    observed = np.zeros(4)
    for page, y in zip(read, labels):
        for k in range(1, len(page.nodes)):
            observed[2 * y[page.nodes[k].parent] + y[k]] += 1
    count = sum(len(p.nodes) for p in read)
    x = np.zeros(len(FEATURES) + 4)
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        grad = np.zeros_like(x)
        grad[-4:] = observed
        for page, y, f in zip(read, labels, features):
            marginals, joints = infer(page, (f @ x[:-4]).tolist(), x[-4:])
            grad[:-4] += (y - np.array(marginals)) @ f
            if len(joints) > 1:
                grad[-4:] -= np.array(joints[1:]).sum(axis=0)
        grad = grad / count - penalty * x
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        x = x + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        if step > steps // 2:
            rate *= 0.97
    return tuple(x[:-4].tolist()), tuple(x[-4:].tolist())


def main_text(html: str, weights: tuple[float, ...], edges: tuple[float, ...], threshold: float = 0.5) -> str:
    page = read_page(html)
    marginals, _ = infer(page, potentials(page, weights), edges)
    blocks = (" ".join(entities.unescape(raw).split()) for node, raw in page.segments if marginals[node] >= threshold)
    return " ".join(b for b in blocks if b)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """id, url and the main text of every page."""
    ship(pages.sparkSession)
    weights, edges = trained()
    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(h.as_py(), weights, edges, threshold) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(lean(run), f"id {kind}, url string, text string").withColumnRenamed("id", id_col)
