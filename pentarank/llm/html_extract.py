"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

Each block is article or not. The field's weights are those of a block's features, from its
ancestors' tags and names and from its text, and of neighbouring labels. They are trained
by gradient ascent on labelled pages and a page is decoded by Viterbi.

Labelled pages come from two sources: pages of the table whose markup names the article, at most
``max_train`` of them, and pages composed here from the layouts that sites use, in which
every block's label is known. The latter teach what a table's own pages may not show.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentarank.llm.html_blocks import Block, Path, blocks

MARK = ""
#: Words in class, id and role names, by what they say of an element.
ROLES = {
    "ad": "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar topbar skip",
    "head": "header masthead head logo tagline branding",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar aside side widget widgets related recommended trending popular more complementary rail",
    "notice": "notice cookie cookies consent gdpr alert popup modal message warning paywall announcement",
    "form": "form subscribe newsletter signup login search register contact",
    "comment": "comment comments disqus reply replies respond discussion reader readers feedback",
    "share": "share sharing social follow tags tag meta byline author date credits",
    "text": "article content post entry story main body text prose blog page",
}
ROLE_OF = {word: role for role, listed in ROLES.items() for word in listed.split()}
# Elements that tell what they hold, and those that matter inside an article.
TELLING = frozenset("article main nav aside footer header form".split())
INNER_TAGS = frozenset("header footer aside nav form section ul article".split())
BOILER_TAGS = frozenset("nav footer aside form".split())
BOILER_ROLES = frozenset("ad menu foot side notice form comment share".split())
CUES = re.compile(r"©|copyright|cookie|subscribe|sign up|log in|all rights|share this|read more|repl(?:y|ies)|comment|advert|sponsor|privacy", re.I)


@dataclass(frozen=True, slots=True)
class _Traits:
    """What is known of a path; equal to its parent's where its element adds nothing."""

    tags: frozenset[str] = frozenset()
    roles: frozenset[str] = frozenset()
    near: str = ""
    in_article: bool = False
    inner: frozenset[str] = frozenset()
    boiler: bool = False
    leaf: str = ""
    features: tuple[str, ...] = ("leaf:",)


def _grown(old: _Traits, entry: tuple[str, ...]) -> _Traits:
    tag, said = entry[0], [ROLE_OF[n] for n in entry[1:] if n in ROLE_OF]
    near = said[0] if said else tag if tag in TELLING else old.near
    inner, boiler = old.inner, old.boiler
    if old.in_article:
        inner = inner.union(said, [tag] if tag in INNER_TAGS else [])
        boiler = boiler or tag in BOILER_TAGS or not BOILER_ROLES.isdisjoint(said)
    if tag == old.leaf and tag in old.tags and near == old.near and old.roles.issuperset(said) and inner == old.inner and boiler == old.boiler and (old.in_article or tag != "article"):
        return old
    tags, roles = old.tags | {tag}, old.roles.union(said)
    found = {f"tag:{t}" for t in tags} | {f"role:{r}" for r in roles} | {f"in:{t}" for t in inner} | {f"leaf:{tag}"}
    if near:
        found.add(f"near:{near}")
    return _Traits(tags, roles, near, old.in_article or tag == "article", inner, boiler, tag, tuple(sorted(found)))


def _traits(path: Path) -> _Traits:
    waiting, node = [], path
    while node.traits is None and node.parent is not None:
        waiting.append(node)
        node = node.parent
    now = node.traits or _Traits()
    for node in reversed(waiting):
        now = node.traits = _grown(now, node.entry)
    return now


def _path_features(path: Path) -> tuple[str, ...]:
    """Tags, roles and the leaf; the nearest telling ancestor, and what lies inside an article."""
    return _traits(path).features


def _text_features(block: Block) -> list[str]:
    text, size = block.text, len(block.text)
    found = [f"len:{min(9, size.bit_length())}", f"links:{min(4, math.ceil(4 * block.linked / size))}"]
    if text[-1] in ".!?…":
        found.append("stop")
    if ", " in text:
        found.append("comma")
    if CUES.search(text):
        found.append("cue" if size < 200 else "cue:long")
    return found


@dataclass(frozen=True)
class Model:
    """``weights`` of features for article against other; ``step[a][b]``: from label ``a`` to ``b``."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def odds(self, page: list[Block], known: dict) -> list[float]:
        out = []
        for block in page:
            features = _path_features(block.path)
            path = known.get(features)
            if path is None:
                if len(known) > 50_000:
                    known.clear()
                path = known[features] = sum(self.weights.get(f, 0.0) for f in features)
            out.append(path + sum(self.weights.get(f, 0.0) for f in _text_features(block)))
        return out

    def decode(self, odds: list[float]) -> list[int]:
        """Viterbi: the likeliest labels of a page's blocks."""
        (s00, s01), (s10, s11) = self.step
        no, yes, back = 0.0, 0.0, []
        for k, score in enumerate(odds):
            if k == 0:
                no, yes = 0.0, score
                continue
            from_no, from_yes = int(yes + s10 > no + s00), int(yes + s11 > no + s01)
            back.append((from_no, from_yes))
            no, yes = max(no + s00, yes + s10), score + max(no + s01, yes + s11)
        label = int(yes > no)
        labels = [label] if odds else []
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.15, decay: float = 1e-4, seed: int = 7) -> Model:
    """Train on blocks with their labels by stochastic gradient ascent on the log-likelihood."""
    index: dict[str, int] = {}
    coded = []
    for page, labels in pages:
        if page:
            rows = [[index.setdefault(f, len(index)) for f in (*_path_features(b.path), *_text_features(b))] for b in page]
            coded.append((np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(labels)))
    weights, step = np.zeros(len(index)), np.zeros((2, 2))
    order, rng = list(range(len(coded))), random.Random(seed)
    for epoch in range(epochs):
        rng.shuffle(order)
        speed = rate / (1 + epoch)
        for k in order:
            ids, owner, labels = coded[k]
            size = len(labels)
            odds = np.bincount(owner, weights[ids], minlength=size)
            unary = np.stack([np.zeros(size), odds], axis=1)
            ahead, behind = np.zeros((size, 2)), np.zeros((size, 2))
            ahead[0] = unary[0]
            for t in range(1, size):
                ahead[t] = unary[t] + np.logaddexp(ahead[t - 1, 0] + step[0], ahead[t - 1, 1] + step[1])
            for t in range(size - 2, -1, -1):
                later = unary[t + 1] + behind[t + 1]
                behind[t] = np.logaddexp(step[:, 0] + later[0], step[:, 1] + later[1])
            total = np.logaddexp(*ahead[-1])
            chance = np.exp(ahead + behind - total)[:, 1]
            np.add.at(weights, ids, speed * (labels - chance)[owner])
            if size > 1:
                seen, expected = np.zeros((2, 2)), np.zeros((2, 2))
                np.add.at(seen, (labels[:-1], labels[1:]), 1.0)
                joint = ahead[:-1, :, None] + step[None] + (unary[1:] + behind[1:])[:, None, :]
                expected = np.exp(joint - total).sum(axis=0)
                step += speed * (seen - expected)
            weights *= 1 - decay * speed
    return Model({f: round(float(weights[i]), 4) for f, i in index.items()}, tuple(map(tuple, step.round(4).tolist())))


def marked(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a composed page, in which article texts start with ``MARK``."""
    found = blocks(page)
    labels = [int(MARK in b.text) for b in found]
    return [Block(b.path, b.text.replace(MARK, ""), b.linked) for b in found], labels


def silver(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page whose markup names its article; None for other pages."""
    found = blocks(page)
    traits = [_traits(b.path) for b in found]
    labels = [int(t.in_article and not t.boiler) for t in traits]
    return (found, labels) if any(labels) else None


class Composer:
    """Composes labelled pages: an article in one of many containers among what surrounds articles."""

    CONTAINERS = (
        "<article>|</article>", "<main><article>|</article></main>", "<main>|</main>", '<div class="content">|</div>',
        '<div id="main-content">|</div>', '<div class="post-body">|</div>', '<div class="entry-content"><section>|</section></div>',
        '<section class="story">|</section>', '<div itemprop="articleBody">|</div>', '<div class="wrap"><div>|</div></div>',
        '<article class="post"><div class="body">|</div></article>', '<table><tr><td>|</td></tr></table>', "<div>|</div>",
    )

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice("ba de lo mi nu ra se ti vo ké en st er ón".split()) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        made = [self.word() + ("," if self.rng.random() < 0.1 else "") for _ in range(self.rng.randint(low, high))]
        return " ".join(made).strip(",").capitalize() + self.rng.choice("....!?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def title(self) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(2, 9))).capitalize()

    def links(self) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.word()}</a></li>' for _ in range(self.rng.randint(2, 8)))

    def one(self, *made: str) -> str:
        return self.rng.choice(made)

    def menu(self) -> str:
        return self.one("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="navigation">{}</ul>', '<div class="breadcrumbs"><ul>{}</ul></div>', "<header><nav><ul>{}</ul></nav></header>").format(self.links())

    def header(self) -> str:
        return self.one("<header><h1>{}</h1><p>{}</p></header>", '<div id="header"><h2>{}</h2><p class="tagline">{}</p></div>', '<div class="masthead"><a href="/">{}</a><span>{}</span></div>', "<header><div>{}</div><p>{}</p></header>").format(self.title(), self.sentence(3, 9))

    def footer(self) -> str:
        said = self.one("&copy; {}.example.com &middot; {}", "Copyright {} {}", "{} {}").format(self.word(), self.prose(1, 3))
        return self.one("<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer"><p>{}</p></div>', '<div id="footer">{}</div>').format(said)

    def side(self) -> str:
        return self.one("<aside><h3>{0}</h3><p>{1}</p></aside>", '<div class="sidebar"><h3>{0}</h3><ul>{2}</ul><p>{1}</p></div>', '<aside class="related"><ul>{2}</ul></aside>', '<div id="sidebar"><div class="widget"><p>{1}</p></div></div>', '<section class="related"><h2>{0}</h2><p>{1}</p></section>').format(self.title(), self.prose(1, 3), self.links())

    def advert(self) -> str:
        return self.one('<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<div class="sponsored"><p>{}</p></div>', '<aside class="promo">{}</aside>', '<p class="ad">{}</p>', '<div id="ad-top"><a href="/x">{}</a></div>', '<section class="banner">{}</section>').format(self.prose(1, 2))

    def notice(self) -> str:
        said = self.one("", "We use cookies. ", "Subscribe now. ") + self.prose(1, 3)
        return self.one('<div class="cookie-notice"><p>{}</p></div>', '<div class="notice">{}</div>', '<div role="alert">{}</div>', '<p class="notice">{}</p>', '<div id="consent"><p>{}</p><button>OK</button></div>', '<section class="notice"><p>{}</p></section>').format(said)

    def form(self) -> str:
        return self.one("<form><label>{0}</label><input name=q><button>{1}</button></form>", '<form class="subscribe"><p>{2}</p><input type=email><button>{1}</button></form>', '<div class="newsletter"><h3>{0}</h3><form><p>{2}</p></form></div>', "<form><fieldset><legend>{0}</legend><p>{2}</p></fieldset></form>").format(self.title(), self.word(), self.sentence())

    def comments(self) -> str:
        one = self.one('<div class="comment"><p>{}</p></div>', '<article class="comment"><p>{}</p></article>', "<li><b>{0}</b><p>{0}</p></li>", "<p>{}</p>", '<div class="reply"><p>{}</p></div>')
        made = "".join(one.format(self.prose(1, 4)) for _ in range(self.rng.randint(1, 4)))
        return self.one('<section class="comments"><h3>Comments</h3>{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<section id="comments"><h2>{0}</h2>{{}}</section>'.format(self.title()), '<div class="discussion">{}</div>').format(made)

    def share(self) -> str:
        return self.one('<div class="share"><a href="/s">{}</a></div>', '<div class="tags"><a href="/t">{}</a></div>', '<ul class="social"><li><a href="/u">{}</a></li></ul>').format(self.word())

    def article(self) -> str:
        parts = [self.one("<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", "").format(MARK + self.title())]
        for _ in range(self.rng.randint(1, 9)):
            said = MARK + self.prose()
            parts.append(self.one("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<pre>{}</pre>").format(said if self.rng.random() < 0.85 else MARK + self.sentence(1, 5)))
            if self.rng.random() < 0.1:
                parts.append(self.one(self.advert(), self.notice(), self.side(), self.form()))
        if self.rng.random() < 0.25:
            parts.append(self.one(self.comments(), self.share(), "<footer><p>{}</p></footer>".format(self.prose(1, 2))))
        return self.rng.choice(self.CONTAINERS).replace("|", "".join(parts))

    def page(self) -> str:
        some = lambda *kinds: [k() for k in kinds if self.rng.random() < 0.5]
        before = some(self.menu, self.header, self.advert, self.notice, self.form, self.side)
        after = some(self.comments, self.side, self.advert, self.footer, self.form, self.notice, self.share)
        self.rng.shuffle(before)
        self.rng.shuffle(after)
        return f"<html><head><title>{self.title()}</title></head><body>{''.join(before)}{self.article()}{''.join(after)}</body></html>"


@lru_cache(maxsize=4)
def composed(count: int, seed: int = 11) -> tuple[tuple[list[Block], list[int]], ...]:
    composer = Composer(seed)
    return tuple(marked(composer.page()) for _ in range(count))


def train(pages: DataFrame, max_train: int = 100, composed_pages: int = 500, html_col: str = "html") -> Model:
    """Fit on composed pages and on about ``max_train`` pages of the table that name their article.

    The sample is drawn by a hash of the page and counts copies once, so the driver gets no more.
    """
    rows = pages.select(F.col(html_col).alias("html")).filter("html is not null")
    share = F.pmod(F.xxhash64(F.lit(3), "html"), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.filter(share < max_train / max(rows.count(), 1)).distinct().toArrow()["html"].to_pylist()
    own = [got for page in sorted(drawn) if (got := silver(page))]
    return fit([*composed(composed_pages), *own])


class Reader:
    """Reads pages with one model; pages share paths and scores of paths."""

    SHARED_PAGES = 1000

    def __init__(self, model: Model):
        self.model, self.known, self.root, self.read = model, {}, Path(), 0

    def extract(self, page: str | None) -> str:
        self.read += 1
        if self.read % self.SHARED_PAGES == 0:
            self.root = Path()
        found = blocks(page or "", self.root)
        labels = self.model.decode(self.model.odds(found, self.known))
        return " ".join(b.text for b, label in zip(found, labels) if label)


def extract(page: str | None, model: Model, known: dict) -> str:
    """One page; ``known`` keeps the scores of paths for later pages."""
    reader = Reader(model)
    reader.known = known
    return reader.extract(page)


def extract_text(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars``, its code points, to ``pages``; columns of these names are replaced.

    NULL, empty and tagless pages are read like any other; a page without article blocks gives an
    empty text. Whole pages are read, however long. Repeated rows are all returned. No shuffle.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(model)
        for batch in batches:
            yield pa.array([reader.extract(p.as_py()) for p in batch], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    read = F.arrow_udf(run, "string")
    return pages.withColumn("text", read(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
