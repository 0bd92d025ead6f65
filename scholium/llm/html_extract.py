"""Main text of web pages, by a tree-structured graphical model over the DOM.

Each block-level element of a page is a binary variable: does it belong to the article? Its own
features (kind of tag, hints in class and id, length, punctuation and links of its text) give a unary
potential; an element and its parent share a potential that depends on how they relate. Sum-product
message passing, upward and then downward over all pages of a batch at once, level by level, gives
every element's exact marginal, and the text blocks whose marginal reaches one half are the article.

The potentials are trained by maximum likelihood (the same message passing gives the expected counts)
on labelled pages: pages of the table that mark their one article by markup, a bounded sample, of
which half have their telling tags and names hidden so that the text itself must speak; and layouts of
this module whose blocks are labelled by hand, for what the sample may lack.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, within

#: Bound of the training sample: pages, and their characters in all.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 32_000_000
_BATCH_PAGES, _BATCH_CHARS = 400, 4 << 20
#: Elements nested deeper than this hang on the one at this depth, as browsers have it.
DEEPEST = 512
#: Failed matches in a page after which the ends of all its tags are worked out at once.
_FAILURES = 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAME = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*+")
_MARK = re.compile("[>\"']")
_LONG_NUMBER = re.compile(r"&#[0-9]{1000,};?")
_NAMES = re.compile(r"\b(?:class|id|role|aria-label|data-testid)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_LABEL = re.compile(r"\bdata-main\b")

#: Elements whose content isn't text of the page. What stands in math, or for readers without scripts, canvas or plug-ins, is.
RAW = {"script", "style", "title", "textarea", "template", "svg", "iframe", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
ASIDE = {"nav", "aside", "footer", "header", "menu", "dialog"}
FORM = {"form", "fieldset", "select", "button", "label", "option", "legend"}
LIST = {"ul", "ol", "li", "dl", "dt", "dd"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
PROSE = {"p", "blockquote", "pre", "figcaption"}
BLOCK = {"body", "html", "div", "section", "figure", "details", "summary", "address", "center", "hgroup", "search"} | HEADINGS | MAIN | ASIDE | FORM | LIST | TABLE | PROSE
#: Elements whose start ends an open paragraph: all blocks.
#: And where the search for one that is still open ends.
ENDS_SEARCH = {"ul", "ol", "dl", "table", "select", "div", "section", "article"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role that hint at what an element is.
AWAY = "ad ads advert advertisement banner breadcrumb breadcrumbs byline cookie cookies comment comments consent copyright disclaimer disqus dropdown footer gdpr header login menu meta modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar tracking widget".split()
HERE = "article body content entry main maincontent post story text".split()

#: Headings of what readers write: the whole heading, in a few languages.
_TALK = re.compile(
    r"\W*(?:(?:\d+|no|all|latest|recent|newest|top|readers?'?s?|users?'?s?|visitors?'?|show|view|hide|the)\s+)*"
    r"(?:comments?|responses?|replies|reactions?|reader feedback|thoughts on .{1,80}|kommentare?|leserkommentare|antworten|commentaires?|réponses|réactions|comentarios?|respuestas|reacciones)"
    r"(?:\s+(?:from|by|by our|of)\s+(?:our\s+)?readers)?\W*\d*\W*"
    r"|\W*(?:leave|post|write|add)\s+a\s+(?:comment|reply|response)\W*|\W*join the (?:conversation|discussion)\W*|\W*what (?:our )?readers say\W*",
    re.I,
)

KINDS = [PROSE, HEADINGS, MAIN, ASIDE, FORM, LIST, TABLE, {"body", "html"}]
UNARY = 1 + len(KINDS) + 4 + 7 + 1
PAIRS = 3  # parent's kind: main, aside or form, other


@dataclass
class Page:
    """Block elements in document order, and text blocks with the element each belongs to."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    labelled: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters inside links


class _Open:
    """The open elements of a page: the stack, and for each tag where in it its elements stand."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.ends: list[int] = []  # places of those that end a search

    def push(self, tag: str, number: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in ENDS_SEARCH:
            self.ends.append(len(self.stack))
        self.stack.append((tag, number))

    def cut(self, at: int) -> None:
        """Close all from a place on."""
        while len(self.stack) > at:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in ENDS_SEARCH:
                self.ends.pop()

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1


class _Ends:
    """Where the tag ends that is scanned from a place on, quoted parts skipped; all worked out in one pass from the page's end."""

    def __init__(self, source: str):
        marks = [(m.start(), m[0]) for m in _MARK.finditer(source)]
        self.at = np.array([i for i, _ in marks], np.int64)
        self.end = [-1] * (len(marks) + 1)
        after = {'"': -1, "'": -1}  # the next mark of either kind
        for k in range(len(marks) - 1, -1, -1):
            place, kind = marks[k]
            if kind == ">":
                self.end[k] = place
            else:
                self.end[k] = self.end[after[kind] + 1] if after[kind] >= 0 else -1
                after[kind] = k

    def __call__(self, start: int) -> int:
        return self.end[int(np.searchsorted(self.at, start))]


def _tags(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or None, whether it closes, attributes) of all tags, comments and declarations.

    A tag that never ends is text. Whoever reads may send the place to go on from.
    """
    at, size, last, failed = 0, len(source), source.rfind(">"), 0
    ends: _Ends | None = None
    while (at := source.find("<", at)) >= 0:
        if at > last and not source.startswith("<!--", at):
            return
        if ends is None:
            m = _TOKEN.match(source, at)
            if m:
                found = (at, m.end(), m[2] and m[2].lower(), m[1] == "/", m[3] or "")
            else:
                found = None
                failed += bool(_NAME.match(source, at))
                ends = _Ends(source) if failed > _FAILURES else None
        else:
            m = _NAME.match(source, at)
            end = ends(m.end()) if m else -1
            if end >= 0:
                closes = source[at + 1] == "/"
                found = (at, end + 1, source[at + 1 + closes : m.end()].lower(), closes, source[m.end() : end])
            else:
                m = _TOKEN.match(source, at) if source.startswith(("<!", "<?"), at) else None
                found = (at, m.end(), None, False, "") if m else None
        if found is None:
            at += 1
            continue
        to = yield found
        at = max(found[1], to or 0)
        if at >= size:
            return


def parse(source: str) -> Page:
    """A page's elements and text blocks; unclosed, stray and crossed tags are mended as browsers mostly do.

    The time is linear in the page's length, whatever is in it.
    """
    page = Page()
    open_ = _Open()
    text: list[str] = []
    linked, links = 0, 0

    def block(tag: str, attributes: str) -> None:
        found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
        page.tag.append(tag)
        page.parent.append(open_.stack[min(len(open_.stack), DEEPEST) - 1][1] if open_.stack else -1)
        page.names.append(found + (" hidden" if attributes and _HIDDEN.search(attributes) else ""))
        page.labelled.append(bool(attributes and _LABEL.search(attributes)))
        open_.push(tag, len(page.tag) - 1)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = html.unescape(_LONG_NUMBER.sub("\ufffd", joined))
            joined = " ".join(joined.split())
            if joined:
                if not page.tag:
                    block("body", "")
                page.blocks.append((open_.stack[-1][1] if open_.stack else 0, joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if links:
                linked += len(piece.strip())

    at, tags = 0, _tags(source)
    found = next(tags, None)
    while found:
        start, end, tag, closing, attributes = found
        add(source[at:start])
        at, skip = end, None
        if tag is None or tag == "head":
            pass
        elif closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                if (place := open_.last(tag)) >= 0:
                    flush()
                    open_.cut(place)
                    links = 0
            elif tag == "br":
                text.append(" ")
        elif tag in RAW:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(source, at)
                at = skip = over.end() if over else len(source)
        elif tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                text.append(" ")
            if tag == "hr":
                flush()
        elif tag in BLOCK:
            flush()
            links = 0
            if tag not in ("html", "body") or open_.last(tag) < 0:
                if (place := open_.last("p")) >= 0:  # a paragraph holds no blocks
                    open_.cut(place)
                if tag in CLOSES:
                    place = max(open_.last(t) for t in CLOSES[tag])
                    if place > (open_.ends[-1] if open_.ends else -1):
                        open_.cut(place)
                block(tag, attributes)
        elif tag == "a":
            links += 1
        try:
            found = tags.send(skip)
        except StopIteration:
            found = None
    add(source[at:])
    flush()
    return page


def talk(page: Page) -> np.ndarray:
    """Elements under a heading that says readers' comments follow: the heading, what stands after it up to a heading of no lower level, and
    the element around them if it begins with that heading."""
    n = len(page.tag)
    out = np.zeros(n, bool)
    heads = [(i, text) for i, text, _ in page.blocks if page.tag[i] in HEADINGS and len(text) <= 120 and _TALK.fullmatch(text)]
    if not heads:
        return out
    children: dict[int, list[int]] = {}
    last = list(range(n))  # the last element of each subtree
    for i in range(n - 1, -1, -1):
        if (p := page.parent[i]) >= 0:
            last[p] = max(last[p], last[i])
    for i, p in enumerate(page.parent):
        children.setdefault(p, []).append(i)
    with_text = np.zeros(n + 1, np.int64)
    for i, *_ in page.blocks:
        with_text[i + 1] += 1
    with_text = np.cumsum(with_text)
    blocks = lambda a, b: int(with_text[b] - with_text[a])  # noqa: E731  in elements a to b - 1, which stand in document order
    for head, _ in reversed(heads):  # later ones first: where an earlier one meets what they have marked, all is done
        level, at = page.tag[head], head
        while (p := page.parent[at]) >= 0 and page.tag[p] not in MAIN and blocks(p, last[p] + 1) == blocks(head, last[head] + 1):
            at = p  # an element around the heading alone
        out[at] = True
        if (p := page.parent[at]) < 0:
            continue
        whole = not blocks(p, at)
        beside = children[p]
        for x in itertools.islice(beside, bisect.bisect_right(beside, at), None):
            if out[x] or (page.tag[x] in HEADINGS and page.tag[x] <= level):
                whole = False
                break
            out[x] = True
        if whole and page.tag[p] not in MAIN and page.tag[p] not in ("body", "html"):
            out[p] = True
    for i, p in enumerate(page.parent):  # parents come first
        out[i] |= p >= 0 and out[p]
    return out


def _kind(tags: list[str], hidden: np.ndarray) -> np.ndarray:
    names = {t: i for i, t in enumerate(dict.fromkeys(tags))}
    rows = np.array([[t in kind for kind in KINDS] for t in names], np.float64).reshape(len(names), len(KINDS))
    out = rows[np.fromiter(map(names.__getitem__, tags), np.int64, len(tags))]
    out[hidden, 2:4] = 0
    return out


class Forest:
    """The elements of many pages as arrays: features, parents and levels."""

    def __init__(self, pages: list[Page], hide: list[bool] | None = None):
        base = np.concatenate([[0], np.cumsum([len(p.tag) for p in pages])]).astype(np.int64)
        self.base = base
        n = int(base[-1])
        self.parent = np.concatenate([np.array(p.parent, np.int64) + np.where(np.array(p.parent) >= 0, b, 0) for p, b in zip(pages, base)] + [np.zeros(0, np.int64)])
        hidden = np.repeat(np.array(hide if hide is not None else [False] * len(pages), bool), np.diff(base))
        tags = [t for p in pages for t in p.tag]
        names = [x for p in pages for x in p.names]
        kind = _kind(tags, hidden)
        away, here, shy = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in [i for i, x in enumerate(names) if x]:
            if not hidden[i]:
                x = names[i]
                parts = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()))
                away[i], here[i], shy[i] = bool(parts & _AWAY), bool(parts & _HERE), "hidden" in parts
        own = np.zeros((n, 4))  # of the text right in an element: characters, in links, sentence ends, blocks
        rank = np.zeros(n)
        for p, b in zip(pages, base.tolist()):
            if p.blocks:
                at, text, linked = zip(*p.blocks)
                where = b + np.array(at, np.int64)
                ends = [t.count(". ") + t.count(", ") + t.endswith((".", "!", "?", "…", ":", "。")) for t in text]
                np.add.at(own, where, np.column_stack([list(map(len, text)), linked, ends, np.ones(len(text))]))
                rank[where] = np.arange(len(text)) / len(text)
        depths: list[int] = []  # parents come first
        for p in self.parent.tolist():
            depths.append(depths[p] + 1 if p >= 0 else 0)
        depth = np.array(depths, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
        below = own.copy()  # of the whole subtree
        for level in reversed(self.levels[1:]):
            np.add.at(below, self.parent[level], below[level])
        chars = np.maximum(below[:, 0], 1)
        shape = [
            np.log1p(own[:, 0]) / 5,
            np.log1p(below[:, 0]) / 8,
            below[:, 1] / chars,
            np.minimum(below[:, 2] / (chars / 60), 2),
            (own[:, 3] > 0).astype(float),
            (own[:, 0] > 80).astype(float),
            rank,
        ]
        said = np.concatenate([talk(p) for p in pages] + [np.zeros(0, bool)]).astype(float)
        self.x = np.column_stack([np.ones(n), kind, away, here, shy, said, *shape, (below[:, 0] == 0).astype(float)])
        self.pair = np.where(self.parent < 0, 0, np.where(kind[self.parent, 2] > 0, 0, np.where(kind[self.parent, 3] + kind[self.parent, 4] + away[self.parent] > 0, 1, 2)))

    def marginals(self, unary: np.ndarray, pairwise: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Each element's P(article), each edge's joint with its parent, and the log partition function.

        unary: weights of features for state 1; pairwise[k, a, b]: log potential of parent a and child b.
        """
        n = len(self.x)
        up = np.zeros((n, 2))
        up[:, 1] = self.x @ unary
        message = np.zeros((n, 2))  # to the parent, for each of its states
        for level in reversed(self.levels[1:]):
            m = np.logaddexp(pairwise[self.pair[level], :, 0] + up[level, :1], pairwise[self.pair[level], :, 1] + up[level, 1:])
            message[level] = m
            np.add.at(up, self.parent[level], m)
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        total = 0.0
        if n:
            top = self.levels[0]
            z = np.logaddexp(up[top, 0], up[top, 1])
            total = float(z.sum())
        for level in self.levels[1:]:
            p = self.parent[level]
            without = up[p] + down[p] - message[level]  # what the parent hears from all others
            j = without[:, :, None] + pairwise[self.pair[level]] + up[level][:, None, :]
            down[level] = np.logaddexp(without[:, 0, None] + pairwise[self.pair[level], 0], without[:, 1, None] + pairwise[self.pair[level], 1])
            j -= np.logaddexp.reduce(j.reshape(len(level), 4), axis=1)[:, None, None]
            joint[level] = np.exp(j)
        both = up + down
        return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1])), joint, total


_AWAY, _HERE = set(AWAY), set(HERE)


@dataclass
class Model:
    unary: np.ndarray
    pairwise: np.ndarray

    def extract(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        forest = Forest(pages)
        keep = forest.marginals(self.unary, self.pairwise)[0] >= 0.5
        return ["\n".join(t for i, t, _ in p.blocks if keep[b + i]) for p, b in zip(pages, forest.base)]


def _train(pages: list[Page], labels: list[np.ndarray], hide: list[bool], steps: int = 400, rate: float = 0.1, ridge: float = 0.02) -> Model:
    """Maximum likelihood by gradient steps (Adam): observed minus expected counts."""
    forest = Forest(pages, hide)
    y = np.concatenate(labels).astype(np.int64)
    edges = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((PAIRS, 2, 2))
    np.add.at(seen, (forest.pair[edges], y[forest.parent[edges]], y[edges]), 1)
    w, v = np.zeros(forest.x.shape[1]), np.zeros((PAIRS, 2, 2))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(v), np.zeros_like(v)]]
    for t in range(1, steps + 1):
        p, joint, _ = forest.marginals(w, v)
        expected = np.zeros_like(v)
        np.add.at(expected, forest.pair[edges], joint[edges])
        for theta, grad, (m1, m2) in zip((w, v), (forest.x.T @ (y - p) - ridge * len(pages) * w, seen - expected - ridge * len(pages) * v), moments):
            g = grad / len(pages)
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            theta += rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Model(w, v)


def _inside(page: Page, roots: set[int], out: set[str]) -> np.ndarray:
    """Elements at or below the roots, without those at or below a tag in ``out``."""
    y = np.zeros(len(page.tag), bool)
    for i, p in enumerate(page.parent):  # parents come first
        y[i] = (i in roots or (p >= 0 and y[p])) and page.tag[i] not in out
    return y


def markup_labels(page: Page) -> np.ndarray | None:
    """Labels of a page that marks exactly one article, without readers' comments inside it; None of any other page."""
    for tag in ("article", "main"):
        found = {i for i, t in enumerate(page.tag) if t == tag}
        if len(found) == 1:
            return _inside(page, found, {"nav", "aside", "footer", "form", "button", "dialog"}) & ~talk(page)
        if found:
            return None
    return None


#: Labelled layouts: what data-main marks, and all below it, is article; {p} a paragraph, {s} a short text, {l} a link, {t} a heading of comments.
LAYOUTS = (
    "<body><header class='site-header'><a href=/>{s}</a><p>{s}</p></header><nav><ul><li>{l}<li>{l}<li>{l}</ul></nav><div id=content><div class=post data-main><h1>{s}</h1><p>{p}<p>{p}<p>{p}<ul><li>{p}<li>{s}</ul><p>{p}</div><div class=comments><h3>{s}</h3><div class=comment><p>{p}</div><div class=comment><p>{p}</div></div></div><aside class=sidebar><h4>{s}</h4><p>{p}</p><ul><li>{l}<li>{l}</ul></aside><footer><p>{p}</p>{l}</footer></body>",
    "<body><div class=cookie-notice><p>{p}</p><button>{s}</button></div><div class=menu>{l}{l}{l}{l}</div><main><article data-main><h1>{s}</h1><h2>{s}</h2><p>{p}</p><blockquote>{p}</blockquote><p>{p}</p><table><tr><td>{s}<td>{s}</table><p>{s}</p></article><section id=comments><h2>{s}</h2><article class=comment><p>{p}</p></article><article class=comment><p>{p}</p></article><form><label>{s}</label><textarea></textarea><button>{s}</button></form></section></main><div id=footer>{s} {l} {l}</div></body>",
    "<body><table><tr><td>{l}<td>{l}<td>{l}</table><div><div class=ad>{p}</div><div data-main><h2>{s}</h2><div>{p}</div><div>{p}</div><div>{p}</div></div><div class='related-posts'><h3>{s}</h3><ul><li>{l}<li>{l}<li>{l}</ul></div></div><div class=copyright>{s}</div></body>",
    "<body><div id=nav>{l} {l} {l}</div><div class=wrap><div class='entry-content' data-main><p>{p}</p><div class=x><p>{p}</p><p>{s}</p></div><h3>{s}</h3><p>{p}</p><pre>{p}</pre><figure><figcaption>{s}</figcaption></figure></div><div class='share-buttons'>{l}{l}</div><div class='newsletter'><p>{p}</p><form>{s}</form></div></div><div class=legal><p>{p}</p></div></body>",
    "<body><p class=notice>{p}</p><div class='ad'>{p}</div><section data-main><h1>{s}</h1><p>{p}</p><p>{p}</p><p>{p}</p></section><ol class=commentlist><li><p>{p}</p><li><p>{p}</p></ol><footer>{p}</footer></body>",
    "<body><div class=top><ul><li>{l}<li>{l}<li>{l}</ul></div><div><div><h1 data-main>{s}</h1><p data-main>{p}</p><p data-main>{p}</p><p data-main>{p}</p><div class=sponsored><p>{p}</p></div><p data-main>{p}</p></div><div><p>{l} {l} {l}</p><p>{s}</p></div></div></body>",
    "<body><nav>{l}{l}</nav><article data-main><h1>{s}</h1><p>{p}</p><p>{p}</p><section><h3>{t}</h3><div><b>{s}</b><p>{p}</p></div><div><b>{s}</b><p>{p}</p></div></section></article><footer>{p}</footer></body>",
    "<body><div>{l}{l}{l}</div><div><div data-main><h1>{s}</h1><p>{p}</p><h2>{s}</h2><p>{p}</p><p>{p}</p><h2>{t}</h2><ul><li><p>{s}</p><p>{p}</p><li><p>{s}</p><p>{p}</p></ul></div></div><div>{s}</div></body>",
    "<body><div>{l}{l}</div><article data-main><h2>{s}</h2><p>{p}</p><p>{p}</p><h2>{s}</h2><p>{p}</p><h2>{t}</h2><div>{p}</div><div>{p}</div><h2>{t}</h2></article><div>{s}</div></body>",
    "<body><main data-main><h1>{s}</h1><div>{p}</div><div>{p}</div><div><div><h4>{t}</h4></div><div><div>{s} {l}</div><div>{p}</div></div><div><div>{s} {l}</div><div>{p}</div></div></div></main><div>{l} {l}</div></body>",
    "<body><nav>{l}{l}</nav><article data-main><header><h1>{s}</h1></header><p>{p}</p><p>{p}</p><aside data-out><p>{p}</p></aside><p>{p}</p></article><footer>{p}</footer></body>",
)


def layouts(seed: int = 3, copies: int = 12) -> tuple[list[Page], list[np.ndarray]]:
    """The labelled layouts, filled with nonsense of natural lengths; what stands under a heading {t} isn't article."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeionrstlu"), rng.integers(1, 9)))
    words = lambda n: " ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(n))
    pages, labels = [], []
    for _ in range(copies):
        for source in LAYOUTS:
            fill = {
                "{p}": lambda: ". ".join(words(int(rng.integers(5, 18))).capitalize() for _ in range(int(rng.integers(1, 7)))) + ".",
                "{s}": lambda: words(int(rng.integers(1, 8))).capitalize() + ("." if rng.random() < 0.3 else ""),
                "{t}": lambda: str(rng.choice(("Comments", "3 responses", "Comments (12)", "Reader comments", "7 replies", "Leave a reply", "Kommentare", "2 comentarios"))),
                "{l}": lambda: f"<a href=/x>{words(int(rng.integers(1, 4)))}</a>",
            }
            page = parse(re.sub(r"\{[pslt]\}", lambda m: fill[m[0]](), source))
            pages.append(page)
            labels.append(_inside(page, {i for i, x in enumerate(page.labelled) if x}, {"aside"}) & ~talk(page))
    return pages, labels


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Train on the labelled layouts and on about SAMPLE_PAGES pages that mark their article.

    The sample is by a hash of id and page among pages that have an article or main element, whatever their length; in the order of the hash they are
    taken while they make no more than SAMPLE_CHARS together, so a page beyond what is left of that is passed over. An empty
    table leaves the layouts.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).withColumns({"at": spread("id", "html"), "size": F.length("html")})
    few = own.where(F.col("at") < within(2 * SAMPLE_PAGES, max(1, own.count())))
    left = SAMPLE_CHARS
    taken: list[int] = []
    for r in few.select("at", "size").orderBy("at", "size").limit(2 * SAMPLE_PAGES).collect():  # numbers only
        if len(taken) < SAMPLE_PAGES and r.size <= left:
            taken.append(r.at)
            left -= r.size
    rows = few.where(F.col("at").isin(taken)).dropDuplicates(["at"]).orderBy("at").select("html").collect() if taken else []
    found, labels = layouts()
    hide = [i % 3 == 2 for i in range(len(found))]
    for r in rows:
        page = parse(r.html)
        y = markup_labels(page)
        if y is not None:
            found.append(page)
            labels.append(y)
            hide.append(len(found) % 2 == 0)
    return _train(found, labels, hide)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row: the article's blocks joined by newlines.

    A null or empty page, or one without an article, gives the empty text. Nothing is cut off, and the time is
    linear in a page's length whatever its markup; rows with null or repeated ids get a result like any other, and
    other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            size = np.cumsum([len(x) if x is not None else 0 for x in rows.column(2).to_pylist()])
            start = 0
            while start < rows.num_rows:  # few pages, or one long one
                full = int(np.searchsorted(size, (size[start - 1] if start else 0) + _BATCH_CHARS))
                part = rows.slice(start, max(1, min(full - start, _BATCH_PAGES)))
                start += part.num_rows
                text = shared.value.extract([x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, "id long, url string, text string, n_chars long")
