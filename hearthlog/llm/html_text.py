"""Main text of web pages: boosted trees over DOM-node features, decoded along the hierarchy.

A page becomes a pre-order list of block nodes; each run of text is a leaf.
The model gives every node a chance that main text lies in it. Decoding picks
the likeliest labels under one rule, that no node is chosen inside one that is
not, so ancestors and descendants never contradict each other.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from . import boosting
from .templates import MARK, labelled_pages

# Pages of the table whose landmarks add training nodes: so many, chosen by
# hash, each up to so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES = 100, 1 << 18
# Pages scored at once.
PAGES_AT_ONCE = 256

INLINE = set("""a abbr acronym audio b bdi bdo big br canvas circle cite code data defs del dfn ellipse em font g i iframe img ins kbd label line map mark math maction menclose merror mfenced mfrac mi
    mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none object path polygon polyline q rect rp rt ruby s samp semantics
    small span strike strong sub sup svg symbol text time tspan tt u use var video wbr""".split())
# form controls and what is never shown; all else is for the model to judge
SILENT = set("script style title template select option optgroup button textarea datalist head".split())
RAW = {"script", "style"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
KINDS = {k: i for i, group in enumerate((
    "#text", "html body", "article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside",
    "form fieldset", "table thead tbody tfoot tr td th caption", "blockquote pre", "figure figcaption", "")) for k in group.split()}
OTHER = 19
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"ul", "ol", "dl", "table", "menu"}  # an implied end does not reach out of these
TOKENS = {word: bit for bit, words in enumerate((
    "article content main post story entry text body maincontent", "nav navigation menu breadcrumb breadcrumbs pagination pager toc", "header masthead banner logo topbar branding",
    "footer contentinfo copyright legal imprint colophon", "sidebar aside side widget related complementary rail recommended recommendations popular trending",
    "ad ads advert advertisement adverts sponsor sponsored promo promotion adsense dfp", "comment comments reply replies discussion disqus respond responses",
    "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall banner", "share sharing social follow", "form login search signup register",
    "hidden none invisible", "meta byline author date tags category")) for word in words.split()}
BITS = 12
# kinds whose ancestors are remembered
LANDMARKS = (2, 3, 6, 9, 10, 11, 12, 13, 14, 15, 16)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_POINTS = re.compile(r"[.,;:!?]")


def _mask(attributes: str) -> int:
    mask = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            mask |= 1 << TOKENS["hidden"]
        elif name in ("class", "id", "role"):
            for word in _WORDS.findall(_HUMP.sub(" ", value).lower()):
                if word in TOKENS:
                    mask |= 1 << TOKENS[word]
    return mask


def parse(html: str | None) -> tuple[list[tuple], list[str | None]]:
    """Nodes of a whole page in pre-order and the texts of the leaves among them.

    A node is (kind, own token bits, ancestors' token bits, ancestors'
    landmark kinds, depth, parent, end, place among siblings, text length,
    link length, punctuation, words).
    """
    html = html or ""
    nodes: list[list] = [[KINDS["html"], 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 0]]
    texts: list[str | None] = [None]
    names, open_, kids = [""], [0], [0]
    held: list[str] = []
    linked = links = silent = 0
    silent_name, inside = "", {}

    def node(kind: int, mask: int, size: int = 0, link: int = 0, points: int = 0, words: int = 0) -> int:
        up = open_[-1]
        above = nodes[up]
        landmark = 1 << above[0] if above[0] in LANDMARKS else 0
        nodes.append([kind, mask, above[1] | above[2], above[3] | landmark, len(open_), up, len(nodes) + 1, kids[up], size, link, points, words])
        kids[up] += 1
        kids.append(0)
        texts.append(None)
        return len(nodes) - 1

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                texts[node(0, 0, len(text), min(linked, len(text)), len(_POINTS.findall(text)), text.count(" ") + 1)] = text
        linked = 0

    def close() -> None:
        nodes[open_.pop()][6] = len(nodes)
        names.pop()

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            if "&" in piece:
                piece = unescape(piece)
            held.append(piece)
            if links:
                linked += len(piece)

    at = 0
    while found := _TAG.search(html, at):
        say(html[at:found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, ends, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if name in SILENT:
            if ends:
                silent = max(0, silent - (name == silent_name))
            elif name in RAW:
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else len(html)
            elif not attributes.endswith("/"):
                if not silent:
                    inside = {}
                if not silent or name == silent_name:
                    silent, silent_name = silent + 1, name
            continue
        if silent:
            if ends and inside.get(name):
                inside[name] -= 1
                continue
            if ends and name not in names or not ends and (name in INLINE or name in VOID or silent_name == "template"):
                if not ends and name not in VOID:
                    inside[name] = inside.get(name, 0) + 1
                continue
            silent = 0  # the parent ends, or a block begins where head, title or a control should have ended
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if ends else 1
            elif name == "br":
                held.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if ends:
            links = 0
            if name in names:
                while names[-1] != name:
                    close()
                close()
            continue
        if "p" in names and names[-1] == "p":
            close()
        if name in CLOSES:
            for i in range(len(names) - 1, -1, -1):
                if names[i] in HOLDS:
                    break
                if names[i] in CLOSES[name]:
                    while len(names) > i:
                        close()
                    break
        if name in ("html", "body") and name in names:
            continue
        open_.append(node(KINDS.get(name, OTHER), _mask(attributes) if attributes else 0))
        names.append(name)
    say(html[at:] if "<" not in html[at:] else html[at:].partition("<")[0] if re.match(r"[^<]*<[a-zA-Z/!]", html[at:]) else html[at:])
    flush()
    while open_:
        close()
    return nodes, texts


def features(nodes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Features of the nodes of several pages; `firsts` has the first node of each, parents and ends are absolute."""
    kind, own, above, marks, depth, parent, end, place, size, link, points, words = nodes.T
    n = len(nodes)
    rows = np.arange(n)

    def below(v: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(v)))
        return total[end] - total[rows]

    text, linked, stops, said = below(size), below(link), below(points), below(words)
    leaves, many = below((kind == 0).astype(np.int64)), end - rows
    page = np.searchsorted(firsts, rows, "right") - 1
    whole = np.maximum(text[firsts][page], 1)
    before = np.concatenate(([0], np.cumsum(size)))[:-1]
    siblings = np.bincount(parent[parent >= 0], minlength=n)
    up = np.maximum(parent, 0)
    largest = np.zeros(n, np.int64)
    np.maximum.at(largest, up, np.where(parent >= 0, text, 0))
    numbers = np.stack([
        depth, np.log1p(text), text / many, linked / np.maximum(text, 1), stops / np.maximum(said, 1), said / np.maximum(leaves, 1), text / whole,
        (before - before[firsts][page]) / whole, place, place / np.maximum(siblings[up], 1), siblings[up], text / np.maximum(largest[up], 1), np.log1p(many),
        np.where(parent >= 0, text[up], text) / whole, linked[up] / np.maximum(text[up], 1), siblings], 1)
    flags = [kind[:, None] == np.arange(OTHER + 1), own[:, None] >> np.arange(BITS) & 1, above[:, None] >> np.arange(BITS) & 1,
             marks[:, None] >> np.array(LANDMARKS) & 1, kind[up][:, None] == np.arange(OTHER + 1)]
    return np.concatenate([numbers, *flags], 1).astype(np.float32)


def _batch(pages: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
    firsts = np.cumsum([0, *map(len, pages)])[:-1]
    nodes = np.array([row for p in pages for row in p], np.int64)
    shift = np.repeat(firsts, [len(p) for p in pages])
    nodes[:, 5] = np.where(nodes[:, 5] >= 0, nodes[:, 5] + shift, -1)
    nodes[:, 6] += shift
    return nodes, firsts


def decode(parents: list[int], odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which every chosen node has a chosen parent."""
    yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    for i in range(len(parents) - 1, 0, -1):
        up = parents[i]
        yes[up] += max(yes[i], no[i])
        no[up] += no[i]
    chosen = [yes[0] > no[0]]
    for i in range(1, len(parents)):
        chosen.append(chosen[parents[i]] and yes[i] > no[i])
    return chosen


def texts_of(pages: list[str | None], model: boosting.Trees) -> list[str]:
    parsed = [parse(html) for html in pages]
    nodes, firsts = _batch([p for p, _ in parsed])
    odds = boosting.scores(model, features(nodes, firsts))
    out = []
    for (rows, texts), first in zip(parsed, firsts):
        chosen = decode([r[5] for r in rows], odds[first:first + len(rows)])
        out.append("\n".join(t for t, c in zip(texts, chosen) if t is not None and c))
    return out


def _contains(nodes: list[tuple], leaves: list[bool]) -> list[bool]:
    """Whether a node is or holds a leaf of the main text."""
    holds = list(leaves)
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i][5]] |= holds[i]
    return holds


def _landmark_labels(nodes: list[tuple]) -> list[bool] | None:
    """Labels of a page that has one article (or main) and marks what is not of it; None if it says too little."""
    mains = [i for i, r in enumerate(nodes) if r[0] == 2] or [i for i, r in enumerate(nodes) if r[0] == 3]
    if len(mains) != 1 or not any(r[0] in (11, 12, 13, 14) for r in nodes):
        return None
    not_main = sum(1 << k for k in (11, 13, 14, 15))
    wrong = sum(1 << TOKENS[w] for w in ("nav", "footer", "sidebar", "ads", "comment", "cookie", "share", "form", "hidden"))
    inside = range(mains[0] + 1, nodes[mains[0]][6])
    return [r[0] == 0 and i in inside and not r[3] & not_main and not r[2] & wrong for i, r in enumerate(nodes)]


def train(pages: DataFrame, key: str = "page_id", payload: str = "html") -> boosting.Trees:
    """Fit on generated layouts and on a bounded sample of the table's own pages that have landmarks."""
    small = pages.where(F.col(key).isNotNull() & (F.octet_length(payload) <= SAMPLE_BYTES)).select(F.col(key).alias("key"), F.col(payload).alias("html"))
    keys = {r["key"] for r in small.select("key", F.xxhash64("key").alias("order")).orderBy("order", "key").limit(SAMPLE_PAGES).collect()}
    chosen = small.where(F.col("key").isin(*keys)).groupBy("key").agg(F.min("html").alias("html")).orderBy("key").select("html").collect() if keys else []
    rows, labels = [], []
    for html in labelled_pages():
        nodes, texts = parse(html)
        rows.append(nodes)
        labels += _contains(nodes, [t is not None and MARK in t for t in texts])
    for html, in chosen:
        nodes, _ = parse(html)
        leaves = _landmark_labels(nodes)
        if leaves is not None:
            rows.append(nodes)
            labels += _contains(nodes, leaves)
    return boosting.fit(features(*_batch(rows)).astype(np.float64), np.array(labels, np.float64))


def extracted(pages: DataFrame, model: boosting.Trees, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """key, url, text, n_chars for every row.

    Character references are decoded, white space inside a block is one
    space, blocks are joined by one newline in page order. Null and empty
    pages and pages without main text give an empty text. Repeated rows get a
    row each. Other columns are not read.
    """

    @pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.tolist()
            yield pd.Series([t for at in range(0, len(values), PAGES_AT_ONCE) for t in texts_of(values[at:at + PAGES_AT_ONCE], model)], dtype=object)

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("address"), main_text(F.col(payload)).alias("text"))
    return rows.select(F.col("key").alias(key), F.col("address").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
