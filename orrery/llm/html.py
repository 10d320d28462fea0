"""Main text of web pages by minimum cut (operator 3).

A page is parsed into blocks of text.  A logistic classifier gives each block a probability of being
content; its log-odds become the capacities to the two terminals.  Smoothness edges join blocks that
follow each other, stronger if they share a parent element, and blocks that are next of kin in the
document tree without being neighbours.  The maximum flow from content to boilerplate leaves the
minimum cut, and the blocks on the content side are the text.

The classifier is trained here, by Newton steps, on labelled blocks of small pages that are built from
a few templates in this module.  It does not see the input, so a page has the same result in any table.

Defined results: null or empty html, and pages without content, give empty text and n_chars 0; broken
markup is read as far as it goes; rows with equal page_id are separate; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never shown as text.
HIDDEN_TAGS = frozenset("script style template noscript iframe object svg math head title canvas audio video textarea select option button datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay in an open head; others, and text, end it.
HEAD_TAGS = frozenset("base link meta title style script noscript template".split())
#: Start tags that end an open svg or math element (fixed values of the HTML standard).
BREAKOUT_TAGS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article aside footer header main nav section".split())
#: Elements that a start tag of the same kind, or of a listed kind, ends.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: Elements out of which an implied end does not reach.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
ENDS_P = BLOCK_TAGS - {"p", "body", "html", "head", "title", "caption", "legend", "option", "button"}
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup popover promo promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
#: A class name with one of these in front tells of something else in the page, or of nothing.
NEGATIONS = frozenset("no not has have with without hide hidden show toggle enable enabled disable disabled is js".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
SPACE = re.compile(r"\s+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
NAMES = ("one", "boilerplate element", "boilerplate name", "content element", "content name", "link share", "length", "sentence marks", "list item", "heading", "paragraph", "page edge")
NEAR, SAME, KIN, EPS = 0.6, 1.6, 0.5, 1e-9


def named(name: str) -> tuple[bool, bool]:
    """Whether the class names and id of an element call it boilerplate, and content.

    A name counts by its parts.  One that begins with a negation tells nothing.  A frame whose other names call it
    content is content, whatever stands at its side: ``content left-sidebar``.
    """
    bad = good = False
    for token in HUMP.sub("-", name).lower().split():
        parts = set(re.split(r"[-_]+", token))
        if re.split(r"[-_]+", token)[0] in NEGATIONS:
            continue
        well = bool(parts & GOOD_WORDS)
        # the header of a post is part of it, its comments are not
        if parts & BAD_WORDS - ({"header"} if well else set()):
            bad = True
        else:
            good |= well
    return bad and not good, good


class _Open:
    """An open element, with what it shares with those around it."""

    __slots__ = ("bad", "bad_tag", "block", "frame", "good", "good_tag", "hidden", "kind", "link", "number", "parent", "tag")


class _Blocks(HTMLParser):
    """Collects (text, features, parent, grandparent, frames) of each block in page order.

    ``frames``: the innermost element around it that is boilerplate by name, with those around that as a linked list.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        root = _Open()
        root.tag, root.number, root.parent, root.block, root.kind, root.frame = "", 0, 0, 0, "", None
        root.hidden = root.bad_tag = root.bad = root.good_tag = root.good = root.link = False
        # places of the open elements of each tag in the stack
        self.stack, self.at = [root], defaultdict(list)
        self.count, self.parts, self.linked, self.length = 0, [], 0, 0
        self.blocks: list[tuple[str, list[float], int, int, tuple | None]] = []

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                top = self.stack[-1]
                marks = sum(map(text.count, ".!?,;:"))
                features = [
                    1.0, float(top.bad_tag), float(top.bad), float(top.good_tag), float(top.good), self.linked / max(self.length, 1), min(len(text), 400) / 400, min(marks / (1 + text.count(" ")), 0.3) / 0.3,
                    float(top.kind in ("li", "dt", "dd", "td", "th")), float(top.kind in ("h1", "h2", "h3", "h4", "h5", "h6")), float(top.kind in ("p", "blockquote", "pre")), 0.0,
                ]
                self.blocks.append((text, features, top.block, top.parent, top.frame))
            self.parts, self.linked, self.length = [], 0, 0

    def _pop(self, to: int) -> None:
        """Close the open elements from place ``to`` on."""
        for x in self.stack[to:]:
            self.at[x.tag].pop()
        del self.stack[to:]

    def _close(self, tags: Iterable[str], stop: Iterable[str] = ()) -> None:
        """Close the innermost open element of ``tags`` with all inside it, unless one of ``stop`` is inside it too."""
        k = max((self.at[t][-1] for t in tags if self.at[t]), default=0)
        if k > max((self.at[t][-1] for t in stop if self.at[t]), default=0):
            self.end_block()
            self._pop(k)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at["head"] and tag not in HEAD_TAGS and not any(x.tag in ("title", "template", "noscript") for x in self.stack[-2:]):
            self._close({"head"})
        if tag in BREAKOUT_TAGS and (self.at["svg"] or self.at["math"]) and not (self.at["foreignobject"] or self.at["annotation-xml"]):
            while self.at["svg"] or self.at["math"]:
                self._close({"svg", "math"})
        if tag in VOID_TAGS:
            if tag == "hr":
                self.end_block()
                self._close({"p"}, FRAMES)
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.end_block()
            if tag in ENDS_P or tag == "p":
                self._close({"p"}, FRAMES)
            if tag in IMPLIED and tag != "p":
                self._close(IMPLIED[tag], SCOPES.get(tag, frozenset()))
        given = dict(attrs)
        top, new = self.stack[-1], _Open()
        role = (given.get("role") or "").lower()
        bad, good = (False, False) if tag in ("html", "body", "main", "article") else named(f"{given.get('class') or ''} {given.get('id') or ''}")
        self.count += 1
        new.tag, new.number = tag, self.count
        new.hidden = top.hidden or tag in HIDDEN_TAGS or "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        # the header of an article holds its title
        own = tag in BAD_TAGS and not (tag == "header" and (self.at["article"] or self.at["main"]))
        new.bad_tag = top.bad_tag or own or role in BAD_ROLES
        new.bad = top.bad or bad
        new.good_tag = top.good_tag or tag in GOOD_TAGS or role in ("main", "article")
        new.good = top.good or good
        new.link = top.link or tag == "a"
        new.frame = (self.count, top.frame) if bad else top.frame
        if tag in BLOCK_TAGS:
            new.block, new.parent, new.kind = self.count, top.block, tag
        else:
            new.block, new.parent, new.kind = top.block, top.parent, top.kind
        self.at[tag].append(len(self.stack))
        self.stack.append(new)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if (self.at["svg"] or self.at["math"]) and self.stack[-1].tag == tag:  # only foreign elements end with their start
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK_TAGS:
            self.end_block()
        if self.at[tag] and tag not in ("body", "html"):
            self._pop(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.at["head"] and self.stack[-1].tag == "head" and data.strip():
            self._close({"head"})
        top = self.stack[-1]
        if not top.hidden:
            self.parts.append(data)
            n = len(data.strip())
            self.length += n
            self.linked += n * top.link


#: Elements that keep a paragraph around them open.
FRAMES = frozenset("body html div article section main nav aside header footer form td th li dd blockquote button table".split())


def blocks(html: str) -> list[tuple[str, list[float], int, int]]:
    """(text, features, parent, grandparent) of the blocks of a page."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    found = parser.blocks
    if found:
        # a name on a frame that holds every block tells nothing of any
        common: set[int] | None = None
        for *_, frame in found:
            mine = set()
            while frame and (common is None or common):
                mine.add(frame[0])
                frame = frame[1]
            common = mine if common is None else common & mine
            if not common:
                break
        if common:
            for _, features, _, _, frame in found:
                while frame and frame[0] in common:
                    frame = frame[1]
                features[2] = float(frame is not None)
        found[0][1][-1] = found[-1][1][-1] = 1.0
    return [x[:4] for x in found]


def _sample() -> tuple[np.ndarray, np.ndarray]:
    """Labelled blocks of pages built from templates; a block that begins with ``+`` is content."""
    words = "the of and water light stone people found river under early later many years first small house work".split()
    rng = np.random.default_rng(5)

    def prose(n: int) -> str:
        out = [str(rng.choice(words)) for _ in range(n)]
        return " ".join(w + ("." if k % 11 == 10 else "," if k % 7 == 6 else "") for k, w in enumerate(out)).capitalize() + "."

    around = [
        "<nav><ul>{links}</ul></nav>", "<header><p>{short}</p><h2>{short}</h2></header>", "<footer>{short}<p>{long}</p></footer>", "<aside><h3>{short}</h3><p>{long}</p></aside>",
        '<div class="ad">{mid}</div>', '<div class="sidebar"><p>{long}</p></div>', '<div class="cookie-notice"><p>{mid}</p></div>', "<form><label>{short}</label><p>{mid}</p></form>",
        '<div id="comments"><h3>{short}</h3><p>{long}</p><p>{mid}</p></div>', '<div class="menu">{links}</div>', "<ul>{links}</ul>", '<section class="comments"><article><p>{long}</p></article></section>',
        '<div class="promo"><a href="x">{mid}</a></div>', '<div role="navigation">{links}</div>', '<div class="related"><ul>{links}</ul></div>', '<div class="newsletter">{mid}</div>',
    ]
    inside = ["<h1>+{short}</h1>", "<p>+{long}</p>", "<p>+{mid}</p>", "<p>+{tiny}</p>", "<ul><li>+{mid}</li><li>+{short}</li></ul>", "<blockquote>+{long}</blockquote>", "<h2>+{short}</h2>", '<p>+{mid} <a href="y">{short}</a></p>', "<div>+{long}</div>", "<pre>+{mid}</pre>"]
    frames = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', "<div>{}</div>", "<article>{}</article>"]
    # frames whose names mislead, so that a name alone does not decide
    odd = ['<div class="widget">{}</div>', '<div class="share"><div>{}</div></div>', '<section id="tags">{}</section>', '<form class="content">{}</form>', '<aside><article>{}</article></aside>']

    def fill(template: str) -> str:
        links = "".join(f'<li><a href="/{k}">{prose(int(rng.integers(1, 4)))}</a></li>' for k in range(int(rng.integers(2, 7))))
        return template.format(links=links, tiny=prose(int(rng.integers(1, 4))), short=prose(int(rng.integers(2, 8))), mid=prose(int(rng.integers(8, 25))), long=prose(int(rng.integers(25, 90))))

    rows, gold = [], []
    for k in range(240):
        top = "".join(fill(str(x)) for x in rng.choice(around, int(rng.integers(0, 4))))
        text = "".join(fill(str(x)) for x in rng.choice(inside, int(rng.integers(1, 8))))
        if rng.random() < 0.25:
            text += fill(str(rng.choice(around)))
        end = "".join(fill(str(x)) for x in rng.choice(around, int(rng.integers(0, 4))))
        for t, f, _, _ in blocks(f"<html><body>{top}{(odd[k // 8 % len(odd)] if k % 8 == 3 else frames[k % len(frames)]).format(text)}{end}</body></html>"):
            rows.append(f)
            gold.append(t.startswith("+"))
    return np.array(rows), np.array(gold, float)


@cache
def classifier(ridge: float = 0.3) -> tuple[float, ...]:
    """Weights of ``NAMES``, by Newton's method on the penalised likelihood."""
    x, y = _sample()
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut.

    ``gain[i]`` above 0 is node i's capacity from the source, below 0 its capacity to the sink; edges have
    the same capacity both ways.  A node whose capacity is that of all its edges together is on its own
    side in some minimum cut; its edges then count for or against its neighbours.  The maximum flow in what
    is left is Dinic's: blocking flows in levels by the distance from nodes with a surplus.
    """
    n = len(gain)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        links[a][b] = links[a].get(b, 0.0) + c
        links[b][a] = links[b].get(a, 0.0) + c
    left, around = list(gain), [sum(x.values()) for x in links]
    side: list[bool | None] = [None] * n
    line = [i for i in range(n) if abs(left[i]) >= around[i]]
    while line:
        i = line.pop()
        if side[i] is None:
            side[i] = left[i] > 0
            for j, c in links[i].items():
                if side[j] is None:
                    left[j] += c if side[i] else -c
                    around[j] -= c
                    if abs(left[j]) >= around[j]:
                        line.append(j)
    rest = [i for i in range(n) if side[i] is None]
    number = {i: k for k, i in enumerate(rest)}
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in rest]
    for i in rest:
        for j, c in links[i].items():
            if i < j and j in number:
                out[number[i]].append(len(to))
                out[number[j]].append(len(to) + 1)
                to += [number[j], number[i]]
                room += [c, c]
    surplus = [left[i] for i in rest]
    while True:
        level = [-1] * len(rest)
        line = [k for k, x in enumerate(surplus) if x > EPS]
        for k in line:
            level[k] = 0
        sources, ends = line, 0
        while line and not ends:  # the nearest level with a deficit is the last
            after = []
            for k in line:
                for e in out[k]:
                    j = to[e]
                    if level[j] < 0 and room[e] > EPS:
                        level[j] = level[k] + 1
                        ends += surplus[j] < -EPS
                        after.append(j)
            line = after
        if not ends:
            break
        at = [0] * len(rest)
        for first in sources:
            path, k = [], first
            while surplus[first] > EPS:
                if surplus[k] < -EPS:
                    push = min(surplus[first], -surplus[k], *(room[e] for e in path))
                    surplus[first] -= push
                    surplus[k] += push
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    path, k = [], first
                    continue
                while at[k] < len(out[k]):
                    e = out[k][at[k]]
                    if level[to[e]] == level[k] + 1 and room[e] > EPS:
                        break
                    at[k] += 1
                if at[k] < len(out[k]):
                    path.append(out[k][at[k]])
                    k = to[path[-1]]
                elif not path:
                    break
                else:
                    k = to[path.pop() ^ 1]
                    at[k] += 1
    for i, x in zip(rest, level, strict=True):
        side[i] = x >= 0
    return [bool(x) for x in side]


def main_text(html: str | None, weights: tuple[float, ...] | None = None) -> str:
    """Content blocks of a page, one on each line."""
    if not html:
        return ""
    weights = weights or classifier()
    found = blocks(html)
    gain = [sum(a * b for a, b in zip(f, weights, strict=True)) for _, f, _, _ in found]
    if any(g > 0 for g in gain) and any(g < 0 for g in gain):
        edges, last, kin = [], {}, {}
        for i, (_, _, parent, grand) in enumerate(found):
            if i:
                edges.append((i - 1, i, SAME if found[i - 1][2] == parent or found[i - 1][3] == grand else NEAR))
            for key, seen in ((parent, last), (grand, kin)):
                if seen.get(key, i - 1) < i - 1:
                    edges.append((seen[key], i, KIN))
                seen[key] = i
        content = min_cut(gain, edges)
    else:
        content = [g > 0 for g in gain]
    return "\n".join(t for (t, _, _, _), c in zip(found, content, strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    weights = classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [main_text(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
