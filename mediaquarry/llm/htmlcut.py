"""Main-text extraction by a minimum cut over the text blocks of a page.

A page becomes text blocks (runs between block-level tags). A logistic classifier gives every block log
odds of being main text: from its words, links, punctuation and tag, and from what the elements around it
say (marks: article, furniture, readers' comments). The odds are the capacities to the two terminals.
Blocks next to each other, and neighbours among the blocks of one parent, are tied with capacities that
fall with their distance in the tree. The cut of least capacity labels the blocks: a heading, a short line
or a list item goes with what it stands in, a prose-like advert or comment with the lines around it.

A block whose odds outweigh all its ties is settled first (no least cut could place it otherwise), the flow
decides the rest. Weights and ties are fitted on labelled pages of three styles, one of them with names
that say nothing (`fit`; tests fit them anew and compare). Parsing takes time in proportion to the page.

Defined results: a null or empty page, or one without content, has empty text; broken markup is read as
browsers do, roughly: unclosed elements (media, lists of options and drawings too) end with their parents, stray
end tags are ignored, a quote opens a value only behind "=", a tag without end and an unclosed comment, script,
style, title, noscript, iframe or textarea take the rest; repeated rows are extracted each; extra columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from html import unescape

from pyspark.sql import DataFrame

from .common import lean, table

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript title textarea iframe".split())  # text up to their end tag, whatever it is
MUTE = frozenset("template object svg head select datalist canvas audio video annotation".split())  # elements whose text is not shown
HEAD = RAW | frozenset("base basefont bgsound link meta template".split())  # what a head can hold
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow msub msup mfrac msqrt semantics".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("body article section main div table ul ol dl nav aside header footer form blockquote".split())
#: Words in class, id and role that mark page furniture, and words that mark the article.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot "
    "masthead topbar toolbar sidebar aside widget widgets rail cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe "
    "subscription signup login register search searchform share sharing social related recommended recommendations trending popular pagination pager copyright legal "
    "disclaimer tags tagcloud skip complementary contentinfo form paywall".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
LAYOUT = frozenset("with has no layout".split())  # "with-sidebar" names a layout, not a sidebar
ARTICLE = frozenset("article content main post entry story text body articlebody maincontent hentry".split())
#: Words that go with any mark and do not weaken it: places, parts and roles of boxes.
NEUTRAL = frozenset("site page top bottom left right center global primary secondary area box block bar list item items inner outer wrap wrapper container section slot unit zone header head title links link module".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog fieldset header".split())
ARTICLE_TAGS = {"article": 1.0, "main": 0.8}
#: Words of a block that go with furniture.
CUES = frozenset("cookies cookie subscribe newsletter reply replies login advertisement sponsored copyright privacy terms imprint follow share tweet unsubscribe \u00a9".split())
HEADINGS, PROSE, ITEMS, CELLS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p blockquote pre".split()), frozenset("li dt dd".split()), frozenset("td th".split())

#: Fitted on labelled pages (see `fit`): log odds for each feature.
FEATURES = "bias article furniture comments words links closed marks heading prose item cell button short cue".split()
WEIGHTS = (-1.17, 4.06, -2.92, -2.28, 0.31, -3.84, -0.83, 0.67, 0.9, 1.32, 2.07, 2.58, -0.42, -0.83, -1.46)
#: Ties: capacity between neighbours in the page (by FADE for each further step in the tree) and in a parent.
NEAR, SIBLING, FADE, FAR = 0.5, 1.5, 0.4, 12
#: Added to all odds of a page that would else have no main text.
RELIEF = 1.0
NEVER = -50.0

# A tag of plain form; it never reads beyond the next "<", so that trying it at each "<" takes linear time in all.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>=]++))?+)*+\s*+/?)>""")
_TAGNAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_BETWEEN = re.compile(r"[\s/]*+")
_NAME = re.compile(r"[^\s/>][^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@functools.lru_cache(maxsize=4096)
def _hints(tag: str, attrs: str) -> tuple[float, float, float, bool]:
    """(article, furniture, comments, hidden): what an element says of what it holds, each from 0 to 1.

    A name counts by the share of its words that are known: "site-footer" fully, "copyright-law" by half.
    """
    article, furniture, comments, hidden = ARTICLE_TAGS.get(tag, 0.0), float(tag in FURNITURE_TAGS), 0.0, False
    for m in _NAMES.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif key in ("class", "id", "role"):
            for name in value.split():
                words = {w.lower() for w in _WORDS.findall(name)} if name.lower() not in FURNITURE | COMMENTS | ARTICLE else {name.lower()}
                own = words - NEUTRAL
                if not own or words & LAYOUT:
                    continue
                comments = max(comments, len(own & COMMENTS) / len(own))
                if tag not in ("body", "html", "article", "main"):
                    furniture = max(furniture, len(own & FURNITURE) / len(own))
                article = max(article, 0.7 * len(own & ARTICLE) / len(own))
    return article, furniture, comments, hidden


def _within(above: tuple, hints: tuple) -> tuple[float, float, float]:
    """Marks inside an element: furniture overrides the article around it, inside furniture an article's
    marks count for little, among comments for nothing."""
    article, furniture, comments = above
    a, f, c = hints[:3]
    if c > comments:
        comments, article = c, article * (1 - c)
    if f > 0:
        furniture, article = max(furniture, f), article * (1 - f)
    elif a > article and not comments:
        article, furniture = a * (1 - furniture) if furniture else a, furniture * (0.8 if furniture > 0.5 else 1 - a)
    return article, furniture, comments


class Block:
    __slots__ = ("text", "links", "node", "marks", "tag")

    def __init__(self, text, links, node, marks, tag):
        self.text, self.links, self.node, self.marks, self.tag = text, links, node, marks, tag


class Tree:
    """The block-level elements of a page: parent and depth of each; node 0 is the page."""

    def __init__(self):
        self.parent, self.depth = [0], [0]

    def add(self, above: int) -> int:
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        return len(self.parent) - 1

    def distance(self, x: int, y: int, far: int = FAR) -> int:
        """Steps from x to y, `far` if there are as many or more."""
        steps = abs(self.depth[x] - self.depth[y])
        if steps >= far:
            return far
        while self.depth[x] > self.depth[y]:
            x = self.parent[x]
        while self.depth[y] > self.depth[x]:
            y = self.parent[y]
        while x != y and steps < far:
            x, y, steps = self.parent[x], self.parent[y], steps + 2
        return min(steps, far)


class Tags:
    """Reads tags from left to right; what lies before a tag's end is never read again."""

    def __init__(self, html: str):
        self.html, self.none_from = html, {}

    def find(self, what: str, at: int) -> int:
        """html.find, with failures remembered: once `what` is missing, it is missing further on."""
        if at >= self.none_from.get(what, len(self.html) + 1):
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.none_from[what] = at
        return k

    def read(self, at: int) -> tuple[bool, str, str, int]:
        """(closing, name, attributes, end) of the tag at "<"; end -1 if it never ends."""
        m = _PLAIN.match(self.html, at)
        if m:
            return m[1] == "/", m[2], m[3], m.end()
        html, closing = self.html, self.html[at + 1] == "/"
        m = _TAGNAME.match(html, at + 1 + closing)
        name, pos, begin = m[0], m.end(), m.end()
        while True:
            pos = _BETWEEN.match(html, pos).end()
            if pos >= len(html):
                return closing, name, "", -1
            if html[pos] == ">":
                return closing, name, html[begin:pos], pos + 1
            pos = _NAME.match(html, pos).end()
            m = _EQUALS.match(html, pos)
            if m is None:
                continue
            pos = m.end()
            if pos < len(html) and html[pos] in "\"'":  # a quote opens a value only here
                close = self.find(html[pos], pos + 1)
                pos = close + 1 if close >= 0 else _BARE.match(html, pos).end()
            else:
                pos = _BARE.match(html, pos).end()


class Open:
    """An open element."""

    __slots__ = ("tag", "node", "marks", "hidden", "name", "mute")

    def __init__(self, tag, node, marks, hidden, name, mute=False):
        self.tag, self.node, self.marks, self.hidden, self.name, self.mute = tag, node, marks, hidden, name, mute


class Stack:
    """Open elements, with counts that tell in one look whether an end tag meets its element: those of inline
    elements since the last other one, those of all others since the last of SCOPE, and of all."""

    def __init__(self):
        self.all: list[Open] = []
        self.opened: dict[str, int] = {}
        self.lines: list[dict[str, int]] = [{}]
        self.scopes: list[dict[str, int]] = [{}]
        self.links = 0

    def push(self, e: Open) -> None:
        self.all.append(e)
        self.links += e.tag == "a"
        for counts in (self.opened, self.lines[-1], self.scopes[-1]):
            counts[e.tag] = counts.get(e.tag, 0) + 1
        if e.tag not in INLINE and not e.mute:
            self.lines.append({})
        if e.tag in SCOPE:
            self.scopes.append({})

    def pop(self) -> Open:
        e = self.all.pop()
        self.links -= e.tag == "a"
        if e.tag in SCOPE:
            self.scopes.pop()
        if e.tag not in INLINE and not e.mute:
            self.lines.pop()
        for counts in (self.opened, self.lines[-1], self.scopes[-1]):
            counts[e.tag] -= 1
        return e

    def meets(self, tag: str) -> bool:
        """Whether the end tag has an open element that it can close."""
        own = self.lines[-1] if tag in INLINE else self.scopes[-1] if tag == "p" else self.opened
        return own.get(tag, 0) > 0


def blocks_of(html: str) -> tuple[list[Block], Tree]:
    out: list[Block] = []
    tree, root = Tree(), Open("", 0, (0.0, 0.0, 0.0), False, "")
    stack, tags = Stack(), Tags(html)
    absent: set[str] = set()  # raw elements with no end tag in the rest of the page
    parts: list[str] = []
    linked, pos, end = 0, 0, len(html)

    def top() -> Open:
        return stack.all[-1] if stack.all else root

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, top().node, top().marks, top().name))
            parts.clear()
        linked = 0

    def say(text):
        nonlocal linked
        if text and not top().hidden:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if stack.links:
                linked += len(text)

    def close(names) -> None:
        """Ends the nearest open element of these names and all inside it."""
        k = len(stack.all) - 1
        while stack.all[k].tag not in names:
            k -= 1
        if any(e.tag not in INLINE and not e.mute for e in stack.all[k:]):
            flush()
        elif any(e.mute and e.tag != "svg" for e in stack.all[k:]):
            parts.append(" ")
        while len(stack.all) > k:
            stack.pop()

    while pos < end:
        at = tags.find("<", pos)
        if at < 0:
            say(html[pos:])
            break
        follows = html[at + 1 : at + 3]
        if not follows[:1].isascii() or not (follows[:1].isalpha() or follows[:1] in "/!?") or not follows:
            say(html[pos : at + 1])  # a plain "<"
            pos = at + 1
            continue
        say(html[pos:at])
        if html.startswith("<!--", at):
            shut = tags.find("-->", at + 4)
            pos = end if shut < 0 else shut + 3
            continue
        if follows[0] in "!?" or follows[0] == "/" and not (follows[1:].isascii() and follows[1:].isalpha()):
            shut = tags.find(">", at)
            pos = end if shut < 0 else shut + 1
            continue
        closing, tag, attrs, pos = tags.read(at)
        if pos < 0:
            break
        tag = tag.lower()
        if closing:
            if stack.meets(tag):
                close((tag,))
            continue
        mute = top().mute
        if stack.opened.get("head") and tag not in HEAD:
            close(("head",))
            mute = top().mute
        if tag in VOID:
            if not mute:
                if tag == "br":
                    parts.append(" ")
                elif tag not in ("wbr", "img", "input"):
                    flush()
            continue
        if tag in RAW:
            if attrs.endswith("/"):
                continue
            m = None if tag in absent else _END(tag).search(html, pos)
            if m is None:
                absent.add(tag)
            parts.append(" ")
            pos = m.end() if m else end
            continue
        if tag == "option" and not mute:  # of a list whose start is lost
            at = tags.find("<", pos)
            pos = at if at >= 0 else end
            continue
        if mute or tag in MUTE:
            if not attrs.endswith("/"):
                if not mute and tag not in ("svg", "head"):
                    parts.append(" ")
                above = top()
                stack.push(Open(tag, above.node, above.marks, True, above.name, True))
            continue
        above = top()
        if tag in INLINE:
            hints = _hints(tag, attrs) if tag != "a" and attrs else (0.0, 0.0, 0.0, False)
            node, name = above.node, above.name
        else:
            flush()
            shut = CLOSES.get(tag, {"p"} if tag in SCOPE or tag in HEADINGS or tag in ("pre", "hr") else ())
            if any(stack.scopes[-1].get(x) for x in shut):
                close(shut)
            hints = _hints(tag, attrs)
            if attrs.endswith("/"):
                continue
            above = top()
            node, name = tree.add(above.node), tag
        if tag == "header" and above.marks[0] > 0.5:
            hints = (hints[0], 0.0, hints[2], hints[3])  # an article's own header holds its title
        stack.push(Open(tag, node, _within(above.marks, hints), above.hidden or hints[3], name))
    flush()
    return out, tree


@functools.cache
def _END(tag: str):
    return re.compile(rf"</{tag}\b[^>]*+>?", re.I)


def features(b: Block) -> list[float]:
    words = b.text.split(" ")
    n = len(words)
    links = min(1.0, b.links / len(b.text))
    marks = sum(map(b.text.count, ".,;:!?")) / n
    cue = n < 40 and any(w.lower().strip(".,:!?()") in CUES for w in words)
    return [
        1.0, *b.marks, math.log1p(min(n, 120)), links, float(b.text[-1] in ".!?\u2026\"\u201d\u00bb:"), min(marks, 0.4), float(b.tag in HEADINGS), float(b.tag in PROSE), float(b.tag in ITEMS),
        float(b.tag in CELLS), float(b.tag == "button"), float(n < 4), float(cue),
    ]


def log_odds(b: Block) -> float:
    """The classifier: log odds that a block is main text. A button's label never is."""
    if b.tag == "button":
        return NEVER
    return sum(w * x for w, x in zip(WEIGHTS, features(b)))


def fit(pages: list[tuple[list[Block], list[bool]]], decay: float = 1e-3, steps: int = 60):
    """Weights of the classifier from labelled blocks, by Newton's method."""
    import numpy as np

    x = np.array([features(b) for blocks, _ in pages for b in blocks])
    y = np.array([float(g) for _, good in pages for g in good])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + decay * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        w = w - np.linalg.solve(curve, grad)
    return w


def ties_of(blocks: list[Block], tree: Tree) -> dict[tuple[int, int], float]:
    """Smoothness capacities: neighbours in the page, and neighbours among the blocks of one parent; the less,
    the more the marks of furniture and comments around both differ."""

    def alike(a: Block, b: Block) -> float:
        return max(0.0, 1 - abs(a.marks[1] - b.marks[1])) * max(0.0, 1 - abs(a.marks[2] - b.marks[2]))

    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            apart = tree.distance(blocks[i - 1].node, b.node)
            if apart < FAR:
                ties[i - 1, i] = NEAR * FADE ** max(0, apart - 2) * alike(blocks[i - 1], b)
        parent = tree.parent[b.node]
        if parent in last:
            ties[last[parent], i] = ties.get((last[parent], i), 0.0) + SIBLING * alike(blocks[last[parent]], b)
        last[parent] = i
    return ties


def min_cut(odds: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: main text) of least cost: odds against their sign, and ties between unlike labels."""
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in ties.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, c in near[i].items():
                odds[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        for i, side in zip(rest, _flow([odds[i] for i in rest], [{place[j]: c for j, c in near[i].items()} for i in rest])):
            label[i] = side
    return [bool(x) for x in label]


def _flow(odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Max flow by level graphs (Dinic); the source side of the cut is main text. Edges lie in flat arrays,
    an edge and its reverse side by side, and each node keeps its place among its edges within a level graph."""
    n = len(odds)
    s, t = n, n + 1
    to, room, first = [], [], [[] for _ in range(n + 2)]

    def edge(u, v, there, back):
        first[u].append(len(to))
        first[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for i, o in enumerate(odds):
        edge(s, i, o, 0.0) if o > 0 else edge(i, t, -o, 0.0)
        for j, c in near[i].items():
            if i < j:
                edge(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for u in queue:
            for e in first[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                push = min(room[e] for e in path)
                cut = len(path)
                for k in range(len(path) - 1, -1, -1):
                    room[path[k]] -= push
                    room[path[k] ^ 1] += push
                    if room[path[k]] <= 1e-12:
                        cut = k
                u = to[path[cut] ^ 1]  # back to the first edge without room
                del path[cut:]
                continue
            while at[u] < len(first[u]):
                e = first[u][at[u]]
                if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(first[u]):
                path.append(e)
                u = to[e]
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
            else:
                break


def labelled(html: str) -> tuple[list[Block], list[bool]]:
    """The blocks of a page and whether each is main text."""
    blocks, tree = blocks_of(html)
    odds, ties = [log_odds(b) for b in blocks], ties_of(blocks, tree)
    keep = min_cut(odds, ties)
    if not any(keep):  # few pages have no main text at all
        keep = min_cut([o + RELIEF for o in odds], ties)
    return blocks, keep


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return " ".join(b.text for b, keep in zip(*labelled(html)) if keep)


def _extract(batches):
    import pyarrow as pa

    for b in batches:
        text = [main_text(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages."""
    lean(pages.sparkSession)
    src = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return src.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_mincut_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
