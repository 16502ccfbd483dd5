"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are runs of text. Each node is boilerplate,
content or mixed (holds both). Its own evidence (tag, words in class and id, link share, length)
gives a potential, and a potential connects the state of a parent with that of each child; messages
passed up and then down the tree (sum-product) give the exact marginals, and the leaves that are
more likely content than not are the text. Long paragraphs under reader comments are outvoted by
their parents this way, and bare text under an article is carried by its own.

The potentials are trained from ``LABELLED_PAGES`` pages written by rule with known labels (layouts,
tags, class words and text lengths vary; the number is constant): element evidence by a softmax
regression, parent-child potentials by smoothed counts. A page is one row, so the work is row-local
and Spark moves nothing.

Defined cases: a null or empty html has an empty text; unclosed or stray tags, quotes and comments
are closed where HTML would; null ids and repeated rows are ordinary rows; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.text import bounded_batches, table

LABELLED_PAGES = 800
SEED = 11
BOILER, CONTENT, MIXED = range(3)

# Element names of HTML by the role they play in parsing.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math canvas object head textarea select option button title".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul caption hr".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: An element of these ends the search for one to close.
SCOPE = set("html body article section div table ul ol dl td th main aside blockquote nav header footer form".split())

# Words in class, id and role that tell what an element is for.
CUES = {
    "good": r"article|content|main|post|story|entry|body|text|prose",
    "menu": r"nav|menu|crumb|toc|tabs?\b|pagina|pager|skip",
    "head": r"header|masthead|topbar|logo|brand",
    "foot": r"foot|copyright|legal|imprint|colophon",
    "side": r"side|aside|rail|widget|related|recommend|popular|trending|more-|teaser",
    "ad": r"\bads?\b|advert|sponsor|promo|banner|affiliate|\bad[-_]|[-_]ad\b",
    "notice": r"cookie|consent|notice|alert|gdpr|popup|modal|overlay|paywall|disclaimer|warning",
    "talk": r"comment|reply|replies|disqus|discussion|respond|guestbook|feedback|reader",
    "form": r"form|login|signup|sign-in|search|subscribe|newsletter",
    "share": r"share|social|follow|tweet|like-|byline|meta|tags?\b|author|date|print",
}
#: What tags tell their children.
ROLES = {"nav": ["menu"], "header": ["head"], "footer": ["foot"], "aside": ["side"], "form": ["form"], "article": ["good"], "main": ["good"]}
_CUES = {k: re.compile(v, re.I) for k, v in CUES.items()}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


class Node:
    """A block element, or with tag ``#text`` a run of text inside one."""

    __slots__ = ("tag", "words", "hidden", "label", "parent", "children", "text", "linked")

    def __init__(self, tag: str, parent: int, words: str = "", hidden: bool = False, label: str | None = None):
        self.tag, self.parent, self.words, self.hidden, self.label = tag, parent, words, hidden, label
        self.children: list[int] = []
        self.text, self.linked = "", 0


def _attributes(raw: str) -> tuple[str, bool, str | None]:
    words, hidden, label = [], False, None
    for m in _ATTRIBUTE.finditer(raw):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words.append(value)
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name == "data-label":
            label = value
    return " ".join(words), hidden, label


def tree(page: str) -> list[Node]:
    """The nodes of a page, parents before their children."""
    nodes = [Node("html", -1)]
    open_tags: list[tuple[str, int]] = [("html", 0)]
    run: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            at = open_tags[-1][1]
            node = Node("#text", at)
            node.text, node.linked = text, min(linked, len(text))
            nodes.append(node)
            nodes[at].children.append(len(nodes) - 1)
        run.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        if any(t in BLOCK for t, _ in open_tags[depth:]):
            flush()
        links -= sum(t == "a" for t, _ in open_tags[depth:])
        del open_tags[depth:]

    def found(names, bound) -> int:
        for k in range(len(open_tags) - 1, 0, -1):
            if open_tags[k][0] in names:
                return k
            if open_tags[k][0] in bound:
                return 0
        return 0

    at, unclosed = 0, set()
    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            run.append(piece)
            linked += len(piece) * (links > 0)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            k = found({name}, {"html", "body"} if name in BLOCK else SCOPE)
            if name == "p" and not k:
                flush()
            elif k:
                close(k)
            continue
        raw = m[3] or m[6] or ""
        if name in RAW and not raw.rstrip().endswith("/"):
            # where one has no end, later ones have none either
            end = None if name in unclosed else re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            if not end:
                unclosed.add(name)
            at = end.end() if end else (at if name in ("head", "noscript", "button", "option", "select") else len(page))
            run.append(" ")
            continue
        if name in ("html", "body") and len(open_tags) <= 2:
            words, hidden, label = _attributes(raw)
            nodes[0].label = label or nodes[0].label
            continue
        if name in VOID:
            if name == "hr":
                flush()
            run.append(" ")
            continue
        if name in BLOCK:
            k = found({"p"}, SCOPE)
            if k:
                close(k)
            if name in CLOSES:
                k = found(CLOSES[name], {"ul", "ol", "dl", "table", "div", "article", "section"} if name in ("li", "dt", "dd") else {"table", "div"})
                if k:
                    close(k)
            flush()
            words, hidden, label = _attributes(raw)
            parent = open_tags[-1][1]
            nodes.append(Node(name, parent, words, hidden, label))
            nodes[parent].children.append(len(nodes) - 1)
            open_tags.append((name, len(nodes) - 1))
        else:
            links += name == "a"
            open_tags.append((name, open_tags[-1][1]))
    flush()
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features that each node has."""
    out = []
    size, linked = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        size[k] += len(x.text)
        linked[k] += x.linked
        if x.parent >= 0:
            size[x.parent] += size[k]
            linked[x.parent] += linked[k]
    cues: list[list[str]] = []
    for k, x in enumerate(nodes):
        own = ["bias", f"tag:{x.tag}"]
        parent = nodes[x.parent] if x.parent >= 0 else None
        # an element without a cue passes on that of the one around it
        named = [c for c, p in _CUES.items() if p.search(x.words)] if x.words else []
        around = cues[x.parent] if parent is not None else []
        cues.append(named or ROLES.get(x.tag) or around)
        own += [f"cue:{c}" for c in named] or ["nocue"]
        own += [f"around:{c}" for c in around]
        if x.hidden:
            own.append("hidden")
        share = linked[k] / size[k] if size[k] else 0.0
        own.append("links:" + ("none" if share < 0.05 else "some" if share < 0.5 else "most"))
        own.append(f"size:{min(10, int(math.log2(size[k] + 1)))}")
        if parent is not None:
            own.append(f"under:{parent.tag}")
        if x.tag == "#text":
            stop = "stop" if re.search(r"[.!?。:;\"')]\s*$", x.text) else "nostop"
            own += [stop, f"links:{'most' if share >= 0.5 else 'few'}:{stop}:{'long' if size[k] >= 60 else 'short'}"]
            if re.search(r"©|copyright|all rights reserved", x.text, re.I):
                own.append("rights")
            if re.search(r"cookie|subscribe|sign up|log in|privacy policy|advertisement", x.text, re.I):
                own.append("service")
        out.append(own)
    return out


class Model:
    """Node weights by feature and potentials of (parent state, child state)."""

    def __init__(self, weights: dict[str, tuple[float, ...]], edges: list[list[float]]):
        self.weights, self.edges = weights, edges

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Sum-product: messages from the leaves to the root, then back."""
        none = (0.0, 0.0, 0.0)
        own = []
        for names in features(nodes):
            s = [0.0, 0.0, 0.0]
            for f in names:
                w = self.weights.get(f, none)
                s[0] += w[0]
                s[1] += w[1]
                s[2] += w[2]
            top = max(s)
            own.append([math.exp(v - top) for v in s])
        for k, x in enumerate(nodes):
            if x.tag == "#text":
                own[k][MIXED] = 0.0
        below, up = [list(v) for v in own], [None] * len(nodes)
        e = self.edges
        for k in range(len(nodes) - 1, 0, -1):
            b = below[k]
            message = [e[p][0] * b[0] + e[p][1] * b[1] + e[p][2] * b[2] for p in range(3)]
            total = sum(message)
            up[k] = [v / total for v in message]
            above = below[nodes[k].parent]
            total = 0.0
            for p in range(3):
                above[p] *= up[k][p]
                total += above[p]
            if total < 1e-200:
                below[nodes[k].parent] = [v / max(total, 1e-300) for v in above]
        out: list[list[float]] = []
        for k, x in enumerate(nodes):
            if k == 0:
                belief = below[0]
            else:
                # what the parent believes without this child
                outer = [a / max(u, 1e-300) for a, u in zip(out[x.parent], up[k], strict=True)]
                belief = [below[k][c] * sum(outer[p] * e[p][c] for p in range(3)) for c in range(3)]
            total = sum(belief) or 1.0
            out.append([v / total for v in belief])
        return out

    def text(self, page: str | None) -> str:
        nodes = tree(page or "")
        marginals = self.marginals(nodes)
        return "\n".join(x.text for x, m in zip(nodes, marginals, strict=True) if x.tag == "#text" and m[CONTENT] > 0.5)


def labelled_page(r: random.Random) -> str:
    """A page whose elements carry ``data-label``: c for content, b for boilerplate."""

    def words(n: int) -> str:
        return " ".join("".join(r.choice("aeioustrnlmdkp") for _ in range(r.randint(2, 9))) for _ in range(n))

    def sentences(n: int) -> str:
        return " ".join(words(r.randint(1, 16)).capitalize() + "." for _ in range(n))

    def service(share: float) -> str:
        return r.choice(["cookie ", "subscribe ", "privacy policy ", "sign up "]) if r.random() < share else ""

    def cue(*names: str) -> str:
        return f' {r.choice(["class", "id"])}="{r.choice(names)}"' if r.random() < 0.9 else ""

    def links(n: int) -> str:
        tag = r.choice(["ul", "div", "ol"])
        inner = "".join(f'<li><a href="/{k}">{words(r.randint(1, 3))}</a></li>' if tag != "div" else f'<a href="/{k}">{words(2)}</a> ' for k in range(n))
        return f"<{tag}>{inner}</{tag}>"

    def content_block() -> str:
        kind = r.random()
        if kind < 0.14:
            # no sentences: rows of words, signs behind each word, one word alone
            sign = r.choice([" | ", "### ", "!! ", " ", "%%% "])
            return f"<p>{sign.join(words(1) for _ in range(r.choice([1, 3, 12, 40, 120])))}</p>"
        if kind < 0.68:
            return f"<p>{service(0.04)}{sentences(r.choice([1, 1, 2, 3, 6]))}</p>"
        if kind < 0.70:
            return f"<p><a href='/x'>{sentences(r.choice([1, 2, 4]))}</a></p>"
        if kind < 0.72:
            return f"<div>{sentences(r.choice([1, 2, 4]))}</div>"
        if kind < 0.76:
            return f"<p><b>{sentences(r.choice([1, 2, 4]))}<br>"
        if kind < 0.82:
            return f"<h{r.randint(2, 4)}>{words(r.randint(1, 6))}</h{r.randint(2, 4)}>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{sentences(1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote><p>{sentences(2)}</p></blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(1)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<p>{sentences(1)} <a href='/x'>{words(2)}</a> {sentences(1)}</p>"
        return f"<figure><figcaption>{sentences(1)}</figcaption></figure>" if r.random() < 0.5 else f"<pre>{sentences(2)}</pre>"

    def boiler(kind: str) -> str:
        b = ' data-label="b"'
        if kind == "nav":
            return f"<{(t := r.choice(['nav', 'nav', 'div']))}{cue('nav', 'menu', 'navbar', 'breadcrumbs', 'main-menu') if t == 'div' else ''}{b}>{links(r.randint(2, 8))}</{t}>"
        if kind == "header":
            return f"<{(t := r.choice(['header', 'div']))}{cue('header', 'masthead', 'site-header', 'topbar') if t == 'div' else ''}{b}><div>{words(r.randint(1, 4))}</div><p>{words(r.randint(2, 8))}</p></{t}>"
        if kind == "footer":
            return f"<{(t := r.choice(['footer', 'footer', 'div']))}{cue('footer', 'site-footer', 'copyright') if t == 'div' else ''}{b}>{r.choice(['&copy; ', 'Copyright ', ''])}{words(2)} &middot; {sentences(r.randint(1, 3))}{r.choice(['', links(3)])}</{t}>"
        if kind == "side":
            return f"<{(t := r.choice(['aside', 'div', 'section']))}{cue('sidebar', 'related', 'widget', 'side-col', 'recommended') if t != 'aside' else r.choice(['', cue('sidebar')])}{b}><h3>{words(2)}</h3>{r.choice([links(4), '<p>' + sentences(r.choice([1, 3, 5])) + '</p>'])}</{t}>"
        if kind == "ad":
            return f"<{(t := r.choice(['div', 'div', 'section', 'p', 'aside']))}{cue('ad', 'advert', 'ad-box', 'sponsored', 'promo', 'banner-ad')}{b}>{sentences(r.choice([1, 1, 2, 4]))}</{t}>"
        if kind == "notice":
            return f"<{(t := r.choice(['div', 'section', 'p', 'dialog']))}{cue('cookie-notice', 'notice', 'consent', 'alert', 'gdpr-banner', 'popup')}{b}>{service(0.4)}{sentences(r.choice([1, 2, 4]))}</{t}>"
        if kind == "form":
            return f"<form{b}{cue('search', 'newsletter', 'login') if r.random() < 0.6 else ''}><label>{words(r.choice([1, 3]))}</label><input name=q>{r.choice(['', f'<p>{service(0.3)}{sentences(r.choice([1, 2]))}</p>'])}</form>"
        if kind == "share":
            return f"<div{cue('share', 'social', 'tags', 'meta')}{b}>{r.choice([links(3), words(4)])}</div>"
        own = r.choice(["<div class='comment'><p>{}</p></div>", "<li><p>{}</p></li>", "<article class='comment'>{}</article>", "<p>{}</p>"])
        talk = "".join(own.format(sentences(r.choice([1, 2, 5, 8]))) for _ in range(r.randint(1, 5)))
        return f"<{(t := r.choice(['section', 'div', 'ol']))}{cue('comments', 'comment-list', 'responses', 'discussion', 'reader-comments')}{b}>{r.choice(['<h2>Comments</h2>', ''])}{talk}</{t}>"

    title = f"<h1>{words(r.randint(2, 9)).capitalize()}</h1>"
    title = title if r.random() < 0.8 else f"<header>{title}</header>"
    blocks = [content_block() for _ in range(r.choice([0, 1, 2, 4, 8, 16]))]
    for kind in ("ad", "share", "talk", "side", "form", "notice"):
        if r.random() < 0.15:
            blocks.insert(r.randint(0, len(blocks)) if kind != "talk" else len(blocks), boiler(kind))
    main = r.choice(["article", "article", "article", "main", "div", "section"])
    name = "" if main in ("article", "main") and r.random() < 0.7 else f' {r.choice(["class", "id"])}="{r.choice(["content", "article-body", "post", "entry", "main", "story"])}"'
    if r.random() < 0.1:
        # the article is a heading and linked paragraphs
        blocks = [f"<p><a href='/x'>{sentences(r.choice([1, 2, 4]))}</a></p>" for _ in range(r.choice([1, 1, 2]))]
    if r.random() < 0.3:
        # nothing tells what an element is for: bare boxes, with or without a heading, or text alone
        kind, n = r.random(), r.choice([1, 2, 4])
        main, name, title = "div", "", title if r.random() < 0.4 else ""
        blocks = [f"<{(t := r.choice(['p', 'p', 'div']))}>{sentences(r.choice([1, 2, 4]))}</{t}>" for _ in range(n)]
        if kind < 0.3:
            return f'<html><body data-label="c">{title}{sentences(2 * n) if kind < 0.15 else "".join(blocks)}</body></html>'
        if kind < 0.7:
            blocks = ["<div>", *blocks, "</div>"]
    body = f'<{main}{name} data-label="c">{title}{"".join(blocks)}</{main}>'
    if r.random() < 0.3:
        body = f'<{r.choice(["div", "main"])}{cue("wrapper", "container", "page", "content")}>{body}{boiler(r.choice(["talk", "side", "share"]))}</div>'
    before = [boiler(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.55]
    after = [boiler(k) for k in ("talk", "side", "share", "ad", "nav", "footer") if r.random() < 0.45]
    r.shuffle(before)
    return "<html><head><title>x</title></head><body>" + "".join(before) + body + "".join(after) + "</body></html>"


def _states(nodes: list[Node]) -> list[int]:
    """Leaves take the label of the nearest labelled ancestor; elements join those of their leaves."""
    near: list[str] = []
    for x in nodes:
        near.append(x.label or (near[x.parent] if x.parent >= 0 else "b"))
    seen: list[set[int]] = [set() for _ in nodes]
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k].tag == "#text":
            seen[k].add(CONTENT if near[k] == "c" else BOILER)
        if nodes[k].parent >= 0:
            seen[nodes[k].parent] |= seen[k]
    return [MIXED if len(s) == 2 else min(s) if s else (CONTENT if near[k] == "c" else BOILER) for k, s in enumerate(seen)]


@lru_cache(maxsize=1)
def trained() -> Model:
    """Fit the potentials on the labelled pages."""
    r = random.Random(SEED)
    rows, states = [], []
    edges = np.full((3, 3), 0.5)
    for _ in range(LABELLED_PAGES):
        nodes = tree(labelled_page(r))
        own = _states(nodes)
        rows += features(nodes)
        states += own
        for k, x in enumerate(nodes[1:], 1):
            edges[own[x.parent], own[k]] += 1
    names = {f: k for k, f in enumerate(dict.fromkeys(f for row in rows for f in row))}
    x = np.zeros((len(rows), len(names)))
    for k, row in enumerate(rows):
        x[k, [names[f] for f in row]] = 1.0
    y = np.eye(3)[states]
    w, speed = np.zeros((len(names), 3)), np.zeros((len(names), 3))
    # longer steps for rare features, or they would stay near zero
    scale = 1 / (x.mean(axis=0)[:, None] + 0.005)
    for _ in range(350):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 0.1 * scale * (x.T @ (p - y) / len(y) + 1e-4 * w)
        w += speed
    # evidence without the states' own frequency, which the parent-child potentials hold
    w[names["bias"]] -= np.log(y.mean(axis=0))
    edges /= edges.sum(axis=1, keepdims=True)
    return Model({f: tuple(float(v) for v in w[k]) for f, k in names.items()}, edges.tolist())


_OUT = "page_id long, url string, text string, n_chars long"


def _extracted(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [model.text(h) for h in pdf["html"]]
            yield pd.DataFrame(
                {"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, text, n_chars, one per page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(_extracted(trained()), _OUT)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
