"""Operator 8, HTML extraction by a tree-structured graphical model.

A page becomes a tree of its block elements.  Each node is content or not; a
node's features (tag, words of class, id and role, amount of text, share of
links, ...) give its own potential, and each parent-child pair has a potential
for its two labels.  One sum-product pass from the leaves to the root and one
back give every node's exact marginal; text of nodes whose marginal is one half
or more is kept.  The weights maximise the likelihood of labelled pages
(``labelled_pages``: written by rule, with the label of every block known), whose
gradient needs just those marginals.

Character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by two line feeds, nothing else is changed.
Null and empty html give an empty text; malformed markup is read as it stands
(unclosed elements end with their parents).  The text of scripts, styles, titles,
text areas, templates and frames is dropped up to their end tag, or to the end of
the page where there is none; a self-closed one is empty within svg or math and
where no end tag follows.  All other text is left to the tree.  Repeated rows are
extracted each; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: element classes of HTML
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe".split())  # skipped to the end tag
FOREIGN = frozenset("svg math".split())
ENDS_P = BLOCKS - frozenset("body button head html label option optgroup".split())
# an element of the first kind ends open ones of the second kind, up to one of the third
IMPLIED = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
    "option": ("option", "select"),
    "optgroup": ("option optgroup", "select"),
    "body": ("head", "html"),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")
_RAW_END = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in RAW}


class Page:
    """Block elements of a page (parent before child) and its runs of text."""

    def __init__(self, html: str):
        self.tag, self.attributes, self.parent = ["html"], [""], [-1]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters of it in links
        stack, at, pieces, linked, in_link = [0], 0, [], 0, 0
        foreign, endless = 0, set()  # open svg and math; tags of RAW without a later end tag

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(pieces).split())
            if text:
                self.runs.append((stack[-1], text, min(linked, len(text))))
            pieces.clear()
            linked = 0

        def close_from(i: int) -> None:
            flush()
            del stack[i:]

        def text_piece(raw: str) -> None:
            nonlocal linked
            if raw:
                pieces.append(unescape(raw) if "&" in raw else raw)
                linked += len(pieces[-1]) if in_link else 0

        while at < len(html):
            m = _TOKEN.search(html, at)
            if not m:
                text_piece(html[at:])
                break
            text_piece(html[at : m.start()])
            at = m.end()
            if not m[2]:
                if foreign and m[0].startswith("<![CDATA["):
                    text_piece(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    in_link = 0
                if tag in FOREIGN:
                    foreign = max(0, foreign - 1)
                if tag in BLOCKS and tag not in ("html", "body"):
                    i = next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == tag), 0)
                    if i:
                        close_from(i)
                    elif tag == "p":
                        flush()
                continue
            closed = m[3].endswith("/") and not _UNQUOTED.search(m[3])
            if tag in FOREIGN:
                foreign += not closed
                continue
            if tag in RAW:
                if closed and foreign:
                    continue
                end = None if tag in endless else _RAW_END[tag].search(html, at)
                if not end:
                    endless.add(tag)
                    if closed:
                        continue
                at = (html.find(">", end.start()) + 1 or len(html)) if end else len(html)
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag == "a":
                in_link = 1
            if tag not in BLOCKS:
                continue
            foreign = 0
            in_link = 0 if tag != "label" else in_link
            if tag in ("html", "body") and any(self.tag[n] == tag for n in stack):
                self.attributes[next(n for n in stack if self.tag[n] == tag)] += m[3]
                continue
            ends, until = IMPLIED.get(tag, ("", ""))
            if tag in ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in ("td", "th", "button"):
                        break
                    if self.tag[stack[i]] == "p":
                        close_from(i)
                        break
            if ends:
                low = len(stack)
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in until.split():
                        break
                    if self.tag[stack[i]] in ends.split():
                        low = i
                if low < len(stack):
                    close_from(low)
            flush()
            if tag == "hr":
                continue
            self.tag.append(tag)
            self.attributes.append(m[3])
            self.parent.append(stack[-1])
            stack.append(len(self.tag) - 1)
        flush()

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        own, links, runs, kids, below = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        stops = [0] * n
        for node, text, linked in self.runs:
            own[node] += len(text)
            links[node] += linked
            runs[node] += 1
            stops[node] += any(c in text for c in ".!?")
        below[:] = own
        for i in range(n - 1, 0, -1):
            below[self.parent[i]] += below[i]
            kids[self.parent[i]] += 1
        total, out, seen = max(1, below[0]), [], 0
        for i in range(n):
            f = ["bias", "tag=" + self.tag[i], f"own={min(4, own[i].bit_length() // 2)}", f"kids={min(4, kids[i].bit_length())}", f"share={4 * below[i] // total}"]
            if own[i]:
                f += [f"links={3 * links[i] // own[i]}", f"stops={stops[i] > 0}", f"tag={self.tag[i]},links={2 * links[i] // own[i]}"]
            if self.parent[i] >= 0:
                f.append("in=" + self.tag[self.parent[i]])
            if self.attributes[i]:
                for k, v in _ATTRIBUTE.findall(self.attributes[i]):
                    if k.lower() != "data-label":
                        f += ["word=" + w for w in _WORD.findall(v.lower())]
            out.append(f)
            seen += own[i]
        return out


_BARE = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt".split())


def _kind(tag: str) -> int:
    """Pairs with a child of plain text and pairs with a container have potentials of their own."""
    return 0 if tag in _BARE else 1


class Model:
    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs  # pairs[kind][parent's label][child's label], as logarithms

    def marginals(self, page: Page, features: list[list[str]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Probability that each node is content, and the joint ones of each node with its parent (00, 01, 10, 11)."""
        n, parent = len(page.tag), page.parent
        own = [2.718281828 ** min(30.0, max(-30.0, sum(self.weights.get(x, 0.0) for x in f))) for f in features]
        pairs = np.exp(self.pairs).tolist()
        up0, up1 = [1.0] * n, own[:]  # product of own potential and messages from below
        send: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            t = pairs[_kind(page.tag[i])]
            a, b = t[0][0] * up0[i] + t[0][1] * up1[i], t[1][0] * up0[i] + t[1][1] * up1[i]
            send[i] = (a / (a + b), b / (a + b))
            p = parent[i]
            x, y = up0[p] * send[i][0], up1[p] * send[i][1]
            up0[p], up1[p] = x / (x + y), y / (x + y)
        down0, down1 = [1.0] * n, [1.0] * n
        content, joint = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        content[0] = up1[0] / (up0[0] + up1[0])
        for i in range(1, n):
            p, t = parent[i], pairs[_kind(page.tag[i])]
            # all that reaches the parent but from this child
            r0, r1 = up0[p] * down0[p] / send[i][0], up1[p] * down1[p] / send[i][1]
            j = (r0 * t[0][0] * up0[i], r0 * t[0][1] * up1[i], r1 * t[1][0] * up0[i], r1 * t[1][1] * up1[i])
            z = sum(j)
            joint[i] = (j[0] / z, j[1] / z, j[2] / z, j[3] / z)
            content[i] = joint[i][1] + joint[i][3]
            a, b = r0 * t[0][0] + r1 * t[1][0], r0 * t[0][1] + r1 * t[1][1]
            down0[i], down1[i] = a / (a + b), b / (a + b)
        return content, joint

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        content = self.marginals(page, page.features())[0]
        return "\n\n".join(text for node, text, _ in page.runs if content[node] >= 0.5)


def train(pages: list[tuple[Page, list[int]]], rounds: int = 12, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Weights by stochastic gradient ascent on the likelihood of labelled pages."""
    model = Model({}, np.zeros((2, 2, 2)))
    ready = [(p, p.features(), y) for p, y in pages]
    for k in range(rounds):
        step = rate / (1 + k / 4)
        for page, features, labels in ready:
            content, joint = model.marginals(page, features)
            for f, y, c in zip(features, labels, content, strict=True):
                d = step * (y - c)
                for x in f:
                    old = model.weights.get(x, 0.0)
                    model.weights[x] = old + d - step * decay * old
            grad = np.zeros((2, 2, 2))
            for i in range(1, len(labels)):
                kind = _kind(page.tag[i])
                grad[kind, labels[page.parent[i]], labels[i]] += 1
                grad[kind] -= np.array(joint[i]).reshape(2, 2)
            model.pairs = np.clip(model.pairs + 0.1 * step * grad, -4, 4)
    return model


# fixed values: words and names for labelled pages
_VOCABULARY = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()
_ARTICLE = ["article", "main", "section", 'div class="content"', 'div class="post"', 'div class="entry-content"', 'div id="content"', 'div class="article-body"', 'div class="story"', "article class=post"]
_AD = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="sponsored"', 'div class="promo"', 'div class="banner"', 'aside class="ad"', 'div id="ad-top"']
_NOTICE = ['div class="cookie"', 'div class="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div id="consent"', 'div class="newsletter"', 'div role="alert"', 'div class="popup"', 'div class="cookie-banner"']
_SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"', 'aside class="sidebar"']
_MENU = ["nav", 'div class="menu"', 'div class="nav"', 'ul class="menu"', 'div class="breadcrumbs"', 'nav class="navbar"', 'div class="share"', 'div class="social"', 'div class="tags"']
_COMMENTS = ['div class="comments"', 'section id="comments"', 'div id="disqus"', 'section class="comments"', 'div class="replies"', 'ol class="comments"']
_FOOT = ["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"']


def labelled_pages(n: int = 240, seed: int = 3) -> list[str]:
    """Pages written by rule; data-label marks the blocks whose text is content."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join(r.choice(_VOCABULARY) for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return words(2, 14).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def prose(a: int = 1, b: int = 6) -> str:
        if r.random() < 0.05:
            return words(20, 150)  # nothing but words
        return " ".join(sentence() for _ in range(r.randint(a, b))) + r.choice(["", "", ' <a href="#">' + words(1, 3) + "</a> " + sentence()])

    def box(opening: str, inside: str) -> str:
        return f"<{opening}>{inside}</{opening.split()[0]}>"

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k)) + "</ul>" if r.random() < 0.7 else " | ".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(k))

    def junk() -> list[str]:
        return [
            box(r.choice(_AD), r.choice([sentence(), f"<p>{prose(1, 2)}</p>", f'<a href="/x">{words(2, 6)}</a>'])),
            box(r.choice(_NOTICE), r.choice([prose(1, 3), f"<p>{prose(1, 3)}</p><button>{words(1, 2)}</button>"])),
            box(r.choice(_SIDE), r.choice([f"<h3>{words(1, 3)}</h3>{links(4)}", f"<h3>{words(1, 3)}</h3><p>{prose(1, 2)}</p>", f"<div><h2>{words(1, 2)}</h2><p>{prose(1, 3)}</p></div>"])),
            box(r.choice(_MENU), links(r.randint(2, 7))),
            f"<form><label>{words(1, 3)}</label><select><option>{words(1, 2)}<option>{words(1, 2)}</select><p>{sentence()}</p><button>{words(1, 1)}</button></form>",
        ]

    out = []
    for _ in range(n):
        y = ' data-label="1"'
        title = words(2, 9).capitalize()
        body = [f"<h1{y}>{title}{r.choice(['', '.'])}</h1>"] if r.random() < 0.8 else []
        if body and r.random() < 0.2:
            body = [f"<header>{body[0]}<p{y}>{prose(1, 2)}</p></header>"]
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12])):
            kind = r.random()
            if kind < 0.66:
                body.append(f"<p{y}>{r.choice(['', '', '<b>'])}{prose()}{r.choice(['', '', '<br>'])}{r.choice(['</p>', '</p>', ''])}")
            elif kind < 0.74:
                body.append(f"<h2{y}>{words(1, 5).capitalize()}</h2>")
            elif kind < 0.8:
                body.append("<ul>" + "".join(f"<li{y}>{words(1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.84:
                body.append(f"<blockquote{y}>{prose(1, 2)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p{y}>{prose(1, 2)}</p></blockquote>")
            elif kind < 0.88:
                body.append("<table>" + "".join(f"<tr><td{y}>{words(1, 3)}</td><td{y}>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.91:
                body.append(f"<pre{y}>{words(3, 12)}</pre>")
            elif kind < 0.94:
                body.append(f"<figure><figcaption{y}>{sentence()}</figcaption></figure>")
            else:
                body.append(r.choice(junk()))
        comments = box(r.choice(_COMMENTS), f"<h3>{words(1, 2)}</h3>" + "".join(box(r.choice(['div class="comment"', "li", 'div class="reply"', 'article class="comment"']), r.choice([f"<p>{prose(1, 5)}</p>", prose(1, 4)])) for _ in range(r.randint(1, 4))))
        inner = "".join(body) + (comments if r.random() < 0.1 else "")
        article = box(r.choice(_ARTICLE), inner) if r.random() < 0.9 else "<div>" + inner + "</div>"
        top = [f"<header>{r.choice(['', f'<h1>{words(1, 3)}</h1>', f'<div class=logo>{words(1, 2)}</div>', f'<p>{sentence()}</p>'])}{box(r.choice(_MENU), links(4))}</header>"] if r.random() < 0.5 else [box(r.choice(_MENU), links(6))]
        top += r.sample(junk(), r.randint(0, 3))
        low = r.sample(junk(), r.randint(0, 2)) + ([comments] if r.random() < 0.4 else []) + [box(r.choice(_FOOT), r.choice([f"&copy; {words(1, 2)} &middot; {sentence()}", f"<p>&copy; {words(1, 3)}</p>{links(3)}", sentence()]))]
        if r.random() < 0.3:
            article = f"<div class={r.choice(['container', 'wrapper', 'page', 'row'])}>{article}{r.choice(junk())}</div>"
        if r.random() < 0.15:  # nothing but an article
            out.append(article)
            continue
        out.append(f"<html><head><title>{title}</title></head><body>{''.join(top)}{article}{''.join(low)}</body></html>")
    return out


def labels_of(page: Page) -> list[int]:
    """A marked node is content; one without text of its own is if most of its children are."""
    n = len(page.tag)
    marked = ["data-label" in a for a in page.attributes]
    own = [0] * n
    for node, text, _ in page.runs:
        own[node] += len(text)
    good, total = [o * m for o, m in zip(own, marked, strict=True)], own[:]
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        total[page.parent[i]] += total[i]
    return [int(marked[i] if own[i] else 2 * good[i] > total[i]) for i in range(n)]


@lru_cache(1)
def trained() -> Model:
    pages = [Page(h) for h in labelled_pages()]
    return train([(p, labels_of(p)) for p in pages])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model.extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained())
