"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each element gets features of its tag, attribute words, depth, text and link density of its subtree, and its siblings.
Boosted trees give the log-odds that it belongs to the article. A dynamic program then labels the tree with outside,
inside and cut: an article starts below outside nodes, parts are cut out of it, and nothing comes back below a cut.

The trees are trained by Spark on a bounded sample of the pages themselves (``SAMPLE``), laid out anew: the blocks of a
sampled page that stand inside or outside its ``article`` or ``main`` element are put into varied page skeletons, so
that the labels are known and the words of class names do not depend on one site.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import bounded_batches
from curalake.session import materialize, scratch_path

SAMPLE = 600
ROUNDS, DEPTH = 15, 4
SEED = 9

# Element names of the HTML standard and common words of class names and ids.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
NEVER = RAW | set("head button select option optgroup datalist label legend object audio video canvas dialog".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "menu"}
TAGS = "nav header footer aside form article main section div p h1 h2 h3 li ul ol table td blockquote pre figure figcaption address dl body".split()
OFF_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs sidebar side rail aside widget widgets ad ads advert adverts advertisement advertising "
    "adsense banner promo promotion sponsor sponsored teaser cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe "
    "subscription signup signin login register form search share sharing social follow related recommended recommendations more popular trending latest "
    "comment comments commentlist reply replies respond discussion disqus responses footer foot bottom copyright legal masthead header topbar top toolbar "
    "pagination pager tags tagcloud meta byline author links skip toc secondary complementary contentinfo utility tracking disclaimer privacy paywall "
    "feedback survey rating donate shop cart thread".split()
)
ON_WORDS = set(
    "article articlebody body content contents copy entry hentry main maincontent page post postbody postcontent prose story text storybody richtext "
    "narrative paragraph lead document primary".split()
)
FEATURES = (
    *[f"tag_{t}" for t in TAGS], "off", "on", "off_above", "on_above", "depth", "chars", "own", "share", "links", "blocks", "mean_block", "stops", "begin", "end",
    "siblings", "same", "sibling_share", "sibling_links", "fields", "nav_above", "article_above",
)

#: A quote opens a value only behind an equals sign, and one that is never closed ends with the page. ``<!-->`` is a whole comment.
_MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=\s*[^\s>"'][^\s>]*+|=)*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_STOPS = re.compile(r"[.,;:!?]")


class Page:
    """Elements of one page in document order, and its blocks of text."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.words, self.marks = [-1], ["#root"], [frozenset()], [None]
        self.fields = [0]
        self.blocks: list[tuple[int, str]] = []  # (element, text), in page order
        self.link_chars: list[int] = []
        self._parse(source.removeprefix("\ufeff"))

    def _parse(self, source: str) -> None:  # noqa: PLR0912
        stack, pieces, in_link, linked, never = [0], [], 0, 0, 0
        at, n = 0, len(source)
        frame: dict[str, int] = {}  # the html and the body element, as they come or as content implies them

        def add(tag: str, words: frozenset[str] = frozenset(), mark: str | None = None) -> None:
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.words.append(words)
            self.marks.append(mark)
            self.fields.append(0)
            stack.append(len(self.tag) - 1)

        def open_frame(*names: str) -> None:
            for name in names:
                if name in frame and stack[-1] == self.parent[frame[name]]:
                    stack.append(frame[name])
                elif name not in frame and self.tag[stack[-1]] == ("#root" if name == "html" else "html"):
                    add(name)
                    frame[name] = stack[-1]

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(pieces).split())
            if text:
                open_frame("html", "body")
                owner = next(e for e in reversed(stack) if self.tag[e] in BLOCK or e == 0)
                self.blocks.append((owner, text))
                self.link_chars.append(min(linked, len(text)))
            pieces.clear()
            linked = 0

        def say(raw: str) -> None:
            nonlocal linked
            if raw and not never:
                text = html.unescape(raw)
                pieces.append(text)
                if in_link:
                    linked += len(text)

        def close(upto: int) -> None:
            nonlocal in_link, never
            for e in stack[upto:]:
                in_link -= self.tag[e] == "a"
                never -= self.tag[e] in NEVER
            del stack[upto:]

        while at < n:
            m = _MARKUP.search(source, at)
            if not m:
                say(source[at:])
                break
            say(source[at : m.start()])
            at = m.end()
            ended, started, attributes = m.groups()
            if ended:
                ended = ended.lower()
                place = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == ended), 0)
                if ended in BLOCK:
                    flush()
                if place:
                    close(place)
                elif ended == "br":
                    say(" ")
            elif started:
                started = started.lower()
                if started == "br" or started == "img":
                    say(" " if started == "br" else "")
                    continue
                if started in BLOCK:
                    flush()
                    k = self._open_p(stack)
                    if k:
                        close(k)
                if started in CLOSED_BY:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] in CLOSED_BY[started]:
                            flush()
                            close(k)
                            break
                        if self.tag[stack[k]] in SCOPE:
                            break
                if started in VOID:
                    if started == "input":
                        open_frame("html", "body")
                        for e in stack:
                            self.fields[e] += 1
                    continue
                if started in RAW:
                    stop = re.compile(rf"</{re.escape(started)}(?=[\s/>])", re.I).search(source, at)
                    if attributes.rstrip().endswith("/") and started in ("svg", "math"):
                        continue
                    at = n if not stop else source.find(">", stop.end()) + 1 or n
                    if started == "textarea":
                        open_frame("html", "body")
                        for e in stack:
                            self.fields[e] += 1
                    continue
                words, mark = self._words(attributes)
                if started in frame:  # repeated, or implied before: one element
                    e = frame[started]
                    self.words[e], self.marks[e] = self.words[e] | words, self.marks[e] or mark
                    open_frame("html", *(["body"] if started == "body" else []))
                    continue
                open_frame(*(() if started == "html" else ("html",) if started in ("head", "body", "frameset") else ("html", "body")))
                if started in ("select", "button"):
                    for e in stack:
                        self.fields[e] += 1
                add(started, words, mark)
                if started in ("html", "body"):
                    frame[started] = stack[-1]
                in_link += started == "a"
                never += started in NEVER
        flush()

    def _open_p(self, stack: list[int]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == "p":
                return k
            if tag in BLOCK:
                return 0
        return 0

    @staticmethod
    def _words(attributes: str) -> tuple[frozenset[str], str | None]:
        if not attributes or "=" not in attributes:
            return frozenset(), None
        words, mark = set(), None
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            value = value.strip("\"'")
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                words.update(w.lower() for w in _WORDS.findall(value))
            elif name == "data-gold":
                mark = value
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                words.add("popup")
        return frozenset(words), mark

    def features(self) -> np.ndarray:
        """One row of ``FEATURES`` per element."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own, links, blocks, stops = (np.zeros(n) for _ in range(4))
        first, last = np.full(n, np.inf), np.zeros(n)
        said = 0
        for (owner, text), linked in zip(self.blocks, self.link_chars, strict=True):
            own[owner] += len(text)
            links[owner] += linked
            blocks[owner] += 1
            stops[owner] += len(_STOPS.findall(text))
            first[owner] = min(first[owner], said)
            said += len(text)
            last[owner] = said
        chars = own.copy()
        for v in range(n - 1, 0, -1):
            p = parent[v]
            chars[p] += chars[v]
            links[p] += links[v]
            blocks[p] += blocks[v]
            stops[p] += stops[v]
            first[p] = min(first[p], first[v])
            last[p] = max(last[p], last[v])
        off = np.array([len(w & OFF_WORDS) for w in self.words], dtype=float)
        on = np.array([len(w & ON_WORDS) for w in self.words], dtype=float)
        depth, off_above, on_above, nav_above, article_above = (np.zeros(n) for _ in range(5))
        children, same = np.zeros(n), {}
        for v in range(1, n):
            p = parent[v]
            depth[v] = depth[p] + 1
            off_above[v] = off_above[p] + (off[p] > 0)
            on_above[v] = on_above[p] + (on[p] > 0)
            nav_above[v] = nav_above[p] or self.tag[p] in ("nav", "footer", "aside", "header", "form")
            article_above[v] = article_above[p] or self.tag[p] in ("article", "main")
            children[p] += 1
            same[p, self.tag[v]] = same.get((p, self.tag[v]), 0) + 1
        total = max(1.0, float(chars[0]))
        up = np.maximum(parent, 0)
        density = links / np.maximum(chars, 1)
        beside = np.maximum(chars[up] - chars, 0)
        table = np.zeros((n, len(FEATURES)))
        for k, tag in enumerate(TAGS):
            table[:, k] = [t == tag for t in self.tag]
        columns = (
            off, on, off_above, on_above, depth, np.log1p(chars), np.log1p(own), chars / total, density, np.log1p(blocks), np.log1p(chars / np.maximum(blocks, 1)),
            stops / np.maximum(chars, 1), np.where(np.isfinite(first), first, said) / total, last / total, np.log1p(children[up]),
            [np.log1p(same.get((int(p), t), 0)) for p, t in zip(parent, self.tag, strict=True)], beside / np.maximum(chars[up], 1), (links[up] - links) / np.maximum(beside, 1),
            np.log1p(self.fields), nav_above, article_above,
        )
        for k, column in enumerate(columns):
            table[:, len(TAGS) + k] = column
        self.own, self.chars = own, chars
        return table

    def decode(self, odds: np.ndarray, enter: float = 1.0, cut: float = 2.0) -> np.ndarray:
        """Whether each element is inside: the labelling with the largest sum, by dynamic programming from the leaves."""
        n = len(self.tag)
        weight = np.log1p(self.own) + 0.5 * np.log1p(self.chars)
        gain = np.clip(odds, -4, 4) * weight
        outside, inside = np.zeros(n), gain.copy()  # the gain of a cut subtree is zero everywhere, as outside it
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            outside[p] += max(outside[v], inside[v] - enter)
            inside[p] += max(inside[v], -cut)
        state = np.zeros(n, dtype=np.int8)  # 0 outside, 1 inside, 2 cut
        for v in range(1, n):
            above = state[self.parent[v]]
            if above == 0:
                state[v] = inside[v] - enter > outside[v]
            elif above == 1:
                state[v] = 1 if inside[v] >= -cut else 2
            else:
                state[v] = 2
        return state == 1

    def text(self, inside: np.ndarray) -> str:
        return "\n".join(text for owner, text in self.blocks if inside[owner])


class Trees:
    """Boosted regression trees as arrays; a node without children is its own successor."""

    def __init__(self, nodes: pd.DataFrame, weights: Sequence[float]) -> None:
        self.parts = []
        for tree, weight in enumerate(weights):
            own = nodes[nodes["tree"] == tree].sort_values("id")
            ids = own["id"].to_numpy()
            leaf = own["left"].to_numpy() < 0
            left, right = (np.where(leaf, ids, own[c].to_numpy()) for c in ("left", "right"))
            self.parts.append((np.where(leaf, 0, own["feature"].to_numpy()), own["cut"].to_numpy(), left, right, own["value"].to_numpy() * weight))

    def odds(self, table: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(table)), np.arange(len(table))
        for feature, cut, left, right, value in self.parts:
            at = np.zeros(len(table), dtype=np.int64)
            for _ in range(DEPTH):
                at = np.where(table[rows, feature[at]] <= cut[at], left[at], right[at])
            total += value[at]
        return 2 * total


def weak_labels(page: Page) -> list[bool]:
    """Elements inside ``article`` or ``main``; those in nav, aside, footer, form or advert elements are outside."""
    state = [False] * len(page.tag)
    for v in range(1, len(page.tag)):
        above = state[page.parent[v]] or page.tag[v] in ("article", "main")
        state[v] = above and not (page.tag[v] in ("nav", "aside", "footer", "form") or page.words[v] & OFF_WORDS)
    return state


def weak_blocks(page: Page) -> tuple[list[str], list[str]]:
    """Block texts inside and outside by ``weak_labels``."""
    state = weak_labels(page)
    return [t for owner, t in page.blocks if state[owner]], [t for owner, t in page.blocks if not state[owner]]


def layout(inner: Sequence[str], outer: Sequence[str], rng: random.Random) -> str:
    """A page with known labels: ``data-gold`` is 1 on article parts and 0 on others; elements without it inherit."""
    pick = rng.choice
    say = html.escape
    outer = list(outer) or ["Home"]
    long = [t for t in inner if len(t) > 60] or list(inner) or ["text"]

    def short(n: int) -> str:
        words = pick(outer).split()
        return " ".join(words[:n]) or "more"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{say(short(2))}</a></li>' for k in range(n))

    def element(names: Sequence[str], body: str, gold: int) -> str:
        name = pick(names)
        tag, _, words = name.partition(".")
        attribute = f' {pick(["class", "class", "id"])}="{words}"' if words else ""
        return f'<{tag}{attribute} data-gold="{gold}">{body}</{tag}>'

    def menu() -> str:
        return element(["nav", "nav.main-nav", "div.menu", "div.navbar", "ul.nav-menu", "div.navigation", "div.breadcrumbs"], f"<ul>{links(rng.randint(3, 9))}</ul>", 0)

    def head() -> str:
        body = f"<h2>{say(short(4))}</h2><p>{say(pick(outer))}</p>" + (menu() if rng.random() < 0.5 else "")
        return element(["header", "header.site-header", "div.header", "div.masthead", "div.top-bar", "div.page-header"], body, 0)

    def advert() -> str:
        body = pick([f"<p>{say(pick(outer))}</p>", say(pick(outer)), f'<a href="#">{say(short(8))}</a>', f"<p>{say(pick(long)[:160])}</p>"])
        return element(["div.ad", "div.ads", "div.advert", "aside.advertisement", "div.sponsored", "div.promo-box", "section.banner", "div.ad-slot"], body, 0)

    def notice() -> str:
        return element(["div.notice", "div.cookie-notice", "div.cookie-banner", "div.consent", "section.alert", "div.gdpr-popup", "p.notification", "aside.notice"],
                       f"<p>{say(pick(outer + long)[:240])}</p><button>OK</button>", 0)

    def aside() -> str:
        body = pick([f"<h3>{say(short(3))}</h3><ul>{links(rng.randint(3, 8))}</ul>", f"<h3>{say(short(3))}</h3><p>{say(pick(long)[:300])}</p>", "".join(f"<p>{say(t)}</p>" for t in rng.sample(long, min(2, len(long))))])
        return element(["aside", "aside.sidebar", "div.sidebar", "div.side-column", "div.widget", "section.related", "div.related-posts", "div.secondary", "div.right-rail"], body, 0)

    def form() -> str:
        return element(["form", "form.newsletter", "div.subscribe-form", "form.search", "form.login", "section.newsletter-signup"],
                       f"<p>{say(pick(outer))}</p><label>{say(short(2))}</label><input name=a><input name=b><button>{say(short(1))}</button>", 0)

    def comments() -> str:
        name = pick(["div.comment", "li.comment", "article.comment", "div.reply", "div.response"])
        tag, _, words = name.partition(".")
        rows = "".join(f'<{tag} class="{words}"><b>{say(short(2))}</b><p>{say(pick(long))}</p></{tag}>' for _ in range(rng.randint(1, 5)))
        return element(["section.comments", "div.comments", "div.comment-list", "section.responses", "div.discussion", "ol.commentlist", "div.reader-comments"], f"<h3>{say(short(2))}</h3>{rows}", 0)

    def foot() -> str:
        body = pick([f"&copy; {say(pick(outer))}", f"<p>{say(pick(outer))}</p><ul>{links(rng.randint(2, 6))}</ul>"])
        return element(["footer", "footer.site-footer", "div.footer", "div.bottom", "div.copyright", "section.page-footer"], body, 0)

    def article() -> str:
        parts = []
        for k, block in enumerate(inner):
            form_of = rng.random()
            parts.append(f"<h1>{say(block)}</h1>" if not k and len(block) < 120 else f"<h2>{say(block)}</h2>" if len(block) < 60 and form_of < 0.3 else f"<div>{say(block)}</div>" if form_of < 0.05
                         else f"<ul><li>{say(block)}</li></ul>" if form_of < 0.12 else f"<blockquote>{say(block)}</blockquote>" if form_of < 0.17 else f"<table><tr><td>{say(block)}</td></tr></table>" if form_of < 0.2
                         else f"<p>{say(block[: len(block) // 2])}<b>{say(block[len(block) // 2 :])}</b></p>" if form_of < 0.3 else f"<p>{say(block)}</p>")
            if rng.random() < 0.06:
                parts.append(pick([advert, aside, form, notice])())
        if rng.random() < 0.25:
            parts.append(element(["div.share", "div.social", "p.tags", "div.post-meta"], "".join(f'<a href="#">{say(short(1))}</a> ' for _ in range(4)), 0))
        if rng.random() < 0.25:
            parts.append(comments())
        body = "".join(parts)
        if rng.random() < 0.3:
            body = f"<div>{body}</div>"
        return element(["article", "article", "main", "div", "div.content", "div.post-content", "div.entry-content", "section.article-body", "div.story", "div.main", "div.post", "section"], body, 1)

    top = [f() for f in (notice, head, menu, advert) if rng.random() < 0.55]
    rng.shuffle(top)
    low = [f() for f in (advert, aside, comments, form, notice, aside) if rng.random() < 0.4]
    middle = [*[f() for f in (aside, menu, advert) if rng.random() < 0.2], article(), *low]
    body = "".join([*top, *middle])
    if rng.random() < 0.4:
        body = "".join(top) + f'<div class="{pick(["wrapper", "container", "page", "layout", "row", "content", "main"])}">{"".join(middle)}</div>'
    if rng.random() < 0.85:
        body += foot()
    return f"<html><head><title>{say(short(5))}</title></head><body>{body}</body></html>"


def gold_labels(page: Page) -> np.ndarray:
    """1 inside, 0 outside, by the nearest element above with a mark."""
    label = np.zeros(len(page.tag), dtype=np.int8)
    for v in range(1, len(page.tag)):
        mark, above = page.marks[v], label[page.parent[v]]
        label[v] = above if mark is None else int(mark == "1" and (page.parent[v] < 1 or above == 1 or not _cut_above(page, v)))
    return label


def _cut_above(page: Page, v: int) -> bool:
    p = page.parent[v]
    while p > 0:
        if page.marks[p] is not None:
            return page.marks[p] == "0"
        p = page.parent[p]
    return False


def training_rows(source: str, seed: int, copies: int = 2) -> list[tuple[float, list[float]]]:
    """(label, features) of elements with text of a page laid out anew, and of the page as it is if it has an article element."""
    page = Page(source)
    inner, outer = weak_blocks(page)
    if not inner:
        return []
    table = page.features()
    rows = [(float(y), x.tolist()) for y, x, c in zip(weak_labels(page), table, page.chars, strict=True) if c > 0]
    for k in range(copies):
        new = Page(layout(inner, outer, random.Random(f"{seed}:{k}")))
        table, label = new.features(), gold_labels(new)
        rows += [(float(y), x.tolist()) for y, x, c in zip(label, table, new.chars, strict=True) if c > 0]
    return rows


def train(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from about ``sample`` pages, chosen by a hash of page_id and url."""
    spark = pages.sparkSession
    total = pages.count()
    draw = F.pmod(F.xxhash64("page_id", "url", F.lit(SEED)), F.lit(1_000_000)) / 1_000_000
    chosen = pages.select("page_id", "url", "html").filter(draw < (sample / total if total else 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, seed in zip(batch["html"].tolist(), batch["seed"].tolist(), strict=True):
                yield pd.DataFrame(training_rows(source or "", seed), columns=["label", "x"])

    bounded_batches(spark)
    rows = chosen.select("html", F.xxhash64("page_id", "url").alias("seed")).mapInPandas(run, "label double, x array<double>")
    rows = materialize(rows.select("label", array_to_vector("x").alias("features")))
    if rows.select("label").distinct().count() < 2:
        return Trees(pd.DataFrame(columns=["tree", "id", "left", "right", "feature", "cut", "value"]), [])
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, seed=SEED, maxBins=32, maxMemoryInMB=128).fit(rows)
    path = scratch_path(spark, "extract-trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("cut"), F.col("nodeData.prediction").alias("value"),
    )
    return Trees(saved.toPandas().fillna({"cut": 0.0}), model.treeWeights)  # at most ROUNDS * 2 ** (DEPTH + 1) rows


def main_text(source: str | None, trees: Trees) -> str:
    return page_texts([source], trees)[0]


def page_texts(sources: Sequence[str | None], trees: Trees) -> list[str]:
    """Main texts; the trees run once over all elements of the batch."""
    pages = [Page(s or "") for s in sources]
    tables = [p.features() for p in pages]
    odds = np.split(trees.odds(np.concatenate(tables)), np.cumsum([len(t) for t in tables])[:-1]) if trees.parts else [np.ones(len(t)) for t in tables]
    return [p.text(p.decode(o)) for p, o in zip(pages, odds, strict=True)]


def main_texts(pages: DataFrame, trees: Trees | None = None, sample: int = SAMPLE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``; a null or empty page has an empty text.

    Block texts in page order, one per line. If the pages hold nothing to learn from, all text outside elements that
    never show text is kept. Repeated rows give repeated results.
    """
    trees = trees or train(pages, sample)
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # at most ROUNDS * 2 ** (DEPTH + 1) nodes
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            held = sources.tolist()
            yield pd.Series([t for k in range(0, len(held), 100) for t in page_texts(held[k : k + 100], shared.value)], dtype=object)

    text = pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("bigint"))
