"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block's features are its ancestors' tags, key words of their class, id and role, and properties of its
text; labels are text and surroundings. The field is trained here, on labelled pages that labelled_pages()
composes, by gradient steps on the conditional likelihood (forward-backward), and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm import dom

TAGS = tuple(
    "article main section nav header footer aside form ul ol li table tr td th h1 h2 h3 h4 h5 h6 p div blockquote pre figure figcaption button select option label "
    "textarea fieldset title head a dl dt dd address details summary menu dialog caption".split()
)
#: Key words that an element's class, id or role may hold, and the feature each stands for.
KEYS = {
    "advert": ("ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "promotion", "adsbygoogle", "banner"),
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "tabs", "topbar", "navigation"),
    "top": ("header", "masthead", "site-header", "logo", "branding"),
    "bottom": ("footer", "foot", "copyright", "colophon", "legal", "contentinfo"),
    "side": ("sidebar", "side", "aside", "widget", "widgets", "related", "recommended", "trending", "popular", "rail", "complementary"),
    "notice": ("cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "disclaimer", "paywall", "message", "toast"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "subscription"),
    "comment": ("comment", "comments", "reply", "replies", "disqus", "discussion", "respond", "commentlist", "feedback", "responses"),
    "share": ("share", "sharing", "social", "follow", "tags", "tag", "meta", "byline", "tools", "print", "author-bio"),
    "body": ("article", "content", "post", "entry", "story", "main", "text", "body", "post-content", "entry-content", "article-body", "page-content", "prose"),
}
_KEY_OF = {word: kind for kind, group in KEYS.items() for word in group}
_TEXT = (
    "words=1 words<=3 words<=8 words<=20 words<=60 words>60 linked>0.8 linked>0.3 stop-end colon-end comma many-commas copyright bar-or-arrow digits upper no-letters question mail-or-url "
    "first second last long-run".split()
)
FEATURES = ("bias", *(f"in:{t}" for t in TAGS), *(f"own:{t}" for t in TAGS), *(f"key:{k}" for k in KEYS), *_TEXT)
_AT = {name: i for i, name in enumerate(FEATURES)}
_SPLIT = re.compile(r"[^a-z0-9-]+")
_RIGHTS, _BARS, _NO_LETTERS, _DIGITS, _ADDRESS = (re.compile(p) for p in (r"©|opyright|ll rights", r"[|»›·]", r"[\W\d_]+", r"\d", r"@|http|www\."))


@functools.lru_cache(maxsize=4096)
def _own(tag: str, marks: str) -> frozenset[int]:
    out = {_AT[f"in:{tag}"]} if f"in:{tag}" in _AT else set()
    for word in _SPLIT.split(marks) if marks else ():
        for part in (word, *word.split("-"), word.rstrip("0123456789-")):
            if kind := _KEY_OF.get(part):
                out.add(_AT[f"key:{kind}"])
    return frozenset(out)


_EMPTY: tuple[frozenset[int], str] = (frozenset(), "")


@functools.lru_cache(maxsize=65536)
def _enter(path: tuple[frozenset[int], str], tag: str, marks: str) -> tuple[frozenset[int], str]:
    return path[0] | _own(tag, marks), tag if tag in dom.BLOCK_TAGS else path[1]


def _text_features(block: dom.Block, place: int, count: int) -> list[int]:
    text, out = block.text, []
    n, size = text.count(" ") + 1, len(text)
    out.append(_AT["words=1" if n == 1 else "words<=3" if n <= 3 else "words<=8" if n <= 8 else "words<=20" if n <= 20 else "words<=60" if n <= 60 else "words>60"])
    share = block.linked / size
    if share > 0.3:
        out.append(_AT["linked>0.8" if share > 0.8 else "linked>0.3"])
    if text[-1] in ".!?…\"”»":
        out.append(_AT["stop-end"])
    elif text[-1] == ":":
        out.append(_AT["colon-end"])
    commas = text.count(",")
    if commas:
        out.append(_AT["many-commas" if commas > 4 else "comma"])
    # Marks of surroundings count by their share of the whole block: one in a long text says nothing.
    if n <= 60 and _RIGHTS.search(text):
        out.append(_AT["copyright"])
    if n <= 6 * len(_BARS.findall(text)):
        out.append(_AT["bar-or-arrow"])
    letters = len(_NO_LETTERS.sub("", text))
    if letters * 2 < size:
        out.append(_AT["no-letters"])
    if len(_DIGITS.findall(text)) * 5 > size:
        out.append(_AT["digits"])
    if letters and text.isupper():
        out.append(_AT["upper"])
    if n <= 30 * text.count("?"):
        out.append(_AT["question"])
    if n <= 30 * len(_ADDRESS.findall(text)):
        out.append(_AT["mail-or-url"])
    if place == 0:
        out.append(_AT["first"])
    elif place == 1:
        out.append(_AT["second"])
    if place == count - 1:
        out.append(_AT["last"])
    return out


def _own_tag(tag: str) -> list[int]:
    return [_AT[f"own:{tag}"]] if f"own:{tag}" in _AT else []


def page_features(page: str) -> tuple[list[dom.Block], list[list[int]]]:
    found = dom.blocks(page, _EMPTY, _enter)
    return found, [[0, *b.path[0], *_own_tag(b.path[1]), *_text_features(b, i, len(found))] for i, b in enumerate(found)]


def marginals(emit: np.ndarray, there: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over n chains at once: chances of each label at each place, of each pair of neighbours, and the
    logs of the partition functions. emit: n x longest x 2; there: n x longest, false past a chain's end."""
    n, longest, _ = emit.shape
    ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    ahead[:, 0] = start + emit[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
        ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(moves[None] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(there[:, t + 1, None], step, 0.0)
    log_z = np.logaddexp.reduce(ahead[:, -1], axis=1)
    p = np.exp(ahead + behind - log_z[:, None, None])
    both = np.exp(ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - log_z[:, None, None, None])
    return p, both, log_z


class Field:
    """Two labels: 0 surroundings, 1 text. weights: per feature, for label 1 over label 0; moves: 2 x 2; start: 2."""

    def __init__(self) -> None:
        self.weights, self.moves, self.start = np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2)

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], steps: int = 250, rate: float = 0.08, ridge: float = 2e-4) -> Field:
        """Adam on the mean log likelihood of the label chains, all pages at once."""
        pages = [p for p in pages if p[0]]
        n, longest = len(pages), max(len(p[0]) for p in pages)
        x = np.zeros((n, longest, len(FEATURES)), np.float32)
        y, there = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, (rows, labels) in enumerate(pages):
            there[i, : len(rows)], y[i, : len(rows)] = True, labels
            for t, row in enumerate(rows):
                x[i, t, row] = 1
        flat = np.zeros(len(FEATURES) + 6)
        mean, square = np.zeros_like(flat), np.zeros_like(flat)
        pair = there[:, 1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        seen_start = np.bincount(y[:, 0], minlength=2)
        total = there.sum()
        for k in range(1, steps + 1):
            w, moves, start = flat[: len(FEATURES)], flat[len(FEATURES) : -2].reshape(2, 2), flat[-2:]
            emit = np.zeros((n, longest, 2))
            emit[..., 1] = x @ w.astype(np.float32)
            p, both, _ = marginals(emit, there, moves, start)
            slope = np.concatenate([
                np.einsum("nt,ntf->f", (y - p[..., 1]) * there, x),
                (seen - (both * pair[..., None, None]).sum(axis=(0, 1))).ravel(),
                seen_start - p[:, 0].sum(axis=0),
            ]) / total - ridge * flat
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            flat = flat + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        self.weights, self.moves, self.start = flat[: len(FEATURES)], flat[len(FEATURES) : -2].reshape(2, 2), flat[-2:]
        return self

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels, by Viterbi; of equally likely ones those of the surroundings."""
        if not rows:
            return []
        w, ((m00, m01), (m10, m11)) = self.weights.tolist(), self.moves.tolist()
        s0, s1 = self.start[0], self.start[1] + sum(w[f] for f in rows[0])
        back = []
        for row in rows[1:]:
            e = sum([w[f] for f in row])
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((a < b, c < d))
            s0, s1 = max(a, b), max(c, d) + e
        label = int(s1 > s0)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


#: Class and id names of the composed pages, as page templates have them: some hold a key word, some hold none.
_NAMES = {
    "advert": ("ad", "ad-slot", "ad-unit", "ads-wrapper", "sponsored-box", "promo-teaser", "banner-top", "dfp-300", "b17", ""),
    "menu": ("navbar-nav", "site-menu", "main-navigation", "breadcrumb", "pager", "topbar", "mnu", ""),
    "side": ("sidebar", "side-col", "widget-area", "related-posts", "recommended-list", "trending-now", "right-rail", "col-3", ""),
    "notice": ("cookie-bar", "consent-banner", "gdpr-popup", "alert-box", "site-notice", "modal-overlay", "js-layer"),
    "share": ("share-buttons", "social-links", "post-tags", "entry-meta", "follow-us", "byline", "icons"),
    "comment": ("comments", "comment-list", "disqus_thread", "replies", "respond", "user-feedback", "discussion-area"),
}


def labelled_pages(n: int = 400, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Composed pages and the texts of their content blocks."""
    rnd = random.Random(seed)
    syllables = "the an or re ing ed on ti le ra de que ion ch sch eit ung os ado mente eau aux ent ir ka lo mi nu".split()

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def phrase(lo: int, hi: int, stop: str = "") -> str:
        words = [word() + ("," if rnd.random() < 0.07 else "") for _ in range(rnd.randint(lo, hi))]
        return " ".join(words).strip(",").capitalize() + stop

    def prose() -> str:
        if rnd.random() < 0.04:  # an article may end in a line on rights of its own
            return rnd.choice(("All rights reserved.", f"Copyright {rnd.randint(1990, 2030)} {word()}. All rights reserved.", f"© {phrase(1, 4, '.')}"))
        size = rnd.choice((3, 8, 20, 60, 150, 150, 400))
        out = " ".join(phrase(2, 14, rnd.choice("...?!")) for _ in range(max(1, size // 8)))
        if rnd.random() < 0.12:
            marks = rnd.choice(("###", "%%%", "$$$", "***", "!!"))
            out = " ".join(w + marks for w in out.split())
        if rnd.random() < 0.06:
            out = " | ".join(out.split())
        if rnd.random() < 0.04:
            out = out.upper()
        if rnd.random() < 0.05:
            out = rnd.choice((f"© {word()} ", f"mail@{word()}.example ", "A | B » ", "1 2 3 4 5 6 7 8 9 " * 9, phrase(20, 60).upper() + " ")) + out
        if rnd.random() < 0.05:
            out += " token = " + "%040x" % rnd.getrandbits(160)
        return out

    def attr(*names: str) -> str:
        return f' {rnd.choice(("class", "id"))}="{rnd.choice(names)}"' if rnd.random() < 0.8 else ""

    def items(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(rnd.randint(2, 8))) + f"</{tag}>"

    def clutter() -> str:
        kind = rnd.randrange(9)
        if kind == 0:
            return f'<div class="{rnd.choice(_NAMES["advert"])}">{phrase(3, 14, ".")} {phrase(2, 9, rnd.choice([".", "!"]))}</div>'
        if kind == 1:
            return f"<aside{attr('sidebar', 'related', 'widget')}><h3>{phrase(1, 3)}</h3>{items()}<p>{phrase(4, 20, '.')}</p></aside>"
        if kind == 2:
            return f'<div class="{rnd.choice(_NAMES["side"])}"><h4>{phrase(1, 4)}</h4><p>{phrase(5, 25, ".")}</p>{items()}</div>'
        if kind == 3:
            return f'<div {rnd.choice(("class", "id"))}="{rnd.choice(_NAMES["notice"])}"><p>{phrase(6, 25, ".")}</p><button>{phrase(1, 2)}</button></div>'
        if kind == 4:
            return f'<form action="/x"><label>{phrase(1, 3)}</label><input name="q"><select><option>{word()}<option>{word()}</select><button>{phrase(1, 2)}</button><p>{phrase(3, 12, ".")}</p></form>'
        if kind == 5:
            return f'<div class="{rnd.choice(_NAMES["share"])}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>'
        if kind == 6:
            return f"<nav{attr('breadcrumb', 'menu')}>" + " › ".join(f'<a href="/">{word()}</a>' for _ in range(3)) + "</nav>"
        if kind == 7:
            return f'<script>var t="</p>";f({rnd.randint(0, 99)});</script><style>p{{margin:0}}</style><!-- {phrase(2, 5)} -->'
        return f'<div class="{rnd.choice(_NAMES["menu"])}">{items()}</div>'

    def comments() -> str:
        name = rnd.choice(_NAMES["comment"])
        each = "".join(f'<{(t := rnd.choice(("div", "li", "p", "article")))} class="{rnd.choice(("comment", "reply", "c"))}"><b>{word()}</b> {phrase(4, 40, ".")}</{t}>' for _ in range(rnd.randint(1, 5)))
        return f'<{(t := rnd.choice(("section", "div")))} {rnd.choice(("id", "class"))}="{name}"><h3>{phrase(1, 2)}</h3>{each}</{t}>'

    for _ in range(n):
        kept: list[str] = []

        def keep(text: str, kept: list[str] = kept) -> str:
            kept.append(" ".join(text.split()))
            return text

        out = [f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{(title := phrase(3, 12))}</title><style>p{{}}</style></head><body>']
        if rnd.random() < 0.5:
            out.append(f"<header{attr('site-header', 'masthead', 'header')}><a href='/'>{phrase(1, 3)}</a><p>{phrase(3, 9)}</p></header>")
        if rnd.random() < 0.8:
            out.append(f"<nav>{items()}</nav>" if rnd.random() < 0.7 else f'<div class="menu">{items()}</div>')
        wrapped = rnd.random() < 0.4
        if wrapped:
            out.append(f"<div{attr('wrap', 'container', 'page', 'l-grid', 'site')}>")
        out += [clutter() for _ in range(rnd.randint(0, 3))]
        opened, closed = rnd.choice([
            ("<article>", "</article>"), ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"),
            ('<div class="content">', "</div>"), ('<div id="main"><div class="entry-content">', "</div></div>"), ('<div class="post">', "</div>"), ("<div><div class='article-body'>", "</div></div>"),
        ])
        out.append(opened)
        if rnd.random() < 0.85:
            out.append(f"<h1>{keep(title if rnd.random() < 0.7 else phrase(3, 12))}</h1>")
        for _ in range(rnd.choice((1, 1, 2, 4, 8, 14))):
            kind = rnd.random()
            if kind < 0.70:
                text = keep(prose())
                out.append(f"<p>{'<b>' if rnd.random() < 0.2 else ''}{text}{rnd.choice(('</p>', '</p>', '<br>'))}")
            elif kind < 0.78:
                out.append(f"<h2>{keep(phrase(2, 7))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{keep(phrase(4, 15, rnd.choice(['', '.'])))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote>{keep(prose())}</blockquote>")
            elif kind < 0.93:
                out.append(f"<pre>{keep(phrase(5, 20))}</pre>")
            elif kind < 0.945:
                out.append(f"<figure><img src='x.png'><figcaption>{keep(phrase(3, 9, '.'))}</figcaption></figure>")
            elif kind < 0.96:
                out.append("<table><tr>" + "".join(f"<td>{keep(phrase(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(clutter())
        if rnd.random() < 0.15:
            out.append(comments())
        out.append(closed)
        if rnd.random() < 0.25:
            out.append(comments())
        out += [clutter() for _ in range(rnd.randint(0, 2))]
        if wrapped and rnd.random() < 0.7:
            out.append("</div>")
        if rnd.random() < 0.9:
            out.append(f"<footer>© {word()}.example · {phrase(2, 14, '.')}</footer>" if rnd.random() < 0.8 else f'<div id="footer"><p>{phrase(2, 12, ".")}</p>{items()}</div>')
        out.append("</body></html>")
        page = "".join(out)
        yield page[: rnd.randint(len(page) // 2, len(page))] if rnd.random() < 0.05 else page, set(kept)


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    pages = []
    for page, kept in labelled_pages():
        found, rows = page_features(page)
        labels = [int((b.text in kept or any(b.text and k.startswith(b.text) for k in kept if i == len(found) - 1)) and _AT["in:title"] not in b.path[0]) for i, b in enumerate(found)]
        pages.append((rows, labels))
    return Field().fit(pages)


def main_text(page: str | None, field: Field) -> str:
    found, rows = page_features(page or "")
    return "\n".join(b.text for b, keep in zip(found, field.decode(rows), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (the content blocks, joined by newlines; empty if none), n_chars.

    Null and empty pages give an empty text; ids and urls may be null or repeat; other columns are not
    read. Malformed markup never fails: what isn't a tag is text, and a tag or comment that the page's
    end cuts off is dropped.
    """
    field = trained()
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), field) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
