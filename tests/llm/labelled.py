"""Pages with known main text, to fit and to judge the block classifier: three styles of markup."""

import random
from html import escape

from .fixtures import VOCAB

NAMED = {
    "page": ["page", "wrapper", "site"], "top": ["header", "masthead", "topbar"], "nav": ["nav", "main-menu", "navbar"], "article": ["article-body", "post", "content", "entry-content"],
    "side": ["sidebar", "widget-area", "right-rail"], "ad": ["ad", "advert", "sponsored", "promo"], "comments": ["comments", "comment-list", "discussion"],
    "foot": ["footer", "site-footer", "copyright"], "notice": ["cookie-banner", "notice", "consent"], "form": ["newsletter", "signup", "search"], "related": ["related", "recommended"],
}
TAGS = {"top": "header", "nav": "nav", "article": "article", "side": "aside", "foot": "footer", "comments": "section", "form": "form"}
CUES = "Reply;Share this;Log in;Read more;Subscribe;Sign up;Terms;Privacy;Next page;Older posts;Print".split(";")


class Page:
    """html, and labels: (text, is it main text) of each block in order."""

    def __init__(self, seed: int, style: str | None = None):
        self.r, self.out, self.labels, self.n = random.Random(seed), [], [], 0
        self.style = style or self.r.choice(["tags", "names", "mute"])
        self.build()
        self.html = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(self.out) + "</body></html>"

    def words(self, n):
        self.n += 1
        return [self.r.choice(VOCAB) for _ in range(n)] + [f"w{self.n}"]

    def sentences(self, low, high):
        out, left = [], self.r.randint(low, high)
        while left > 0:
            k = min(left, self.r.randint(3, 18))
            w = self.words(k)
            if k > 6 and self.r.random() < 0.6:
                w[k // 2] += ","
            out.append(" ".join(w).capitalize() + self.r.choice(["."] * 8 + ["!", "?"]))
            left -= k
        return " ".join(out)

    def label(self, low=1, high=4):
        return " ".join(self.words(self.r.randint(low, high) - 1)).capitalize()

    def block(self, tag, text, good, link=False):
        self.labels.append((" ".join(text.split()), good))
        inner = f"<a href=/{self.n}>{escape(text)}</a>" if link else escape(text)
        if not link and good and tag == "p" and self.r.random() < 0.25:  # markup and links inside a paragraph
            w = text.split(" ")
            k = self.r.randrange(len(w))
            w[k] = f"<a href=/{self.n}>{w[k]}</a>" if self.r.random() < 0.5 else f"<em>{w[k]}</em>"
            inner = " ".join(w)
        self.out.append(f"<{tag}>{inner}</{tag}>")

    def box(self, kind, fill):
        tag, attr = "div", ""
        if self.style == "tags" and kind in TAGS:
            tag = TAGS[kind]
        if self.style == "names" or self.style == "tags" and kind not in TAGS:
            attr = f' class="{self.r.choice(NAMED[kind])}"'
        elif self.style == "mute" and self.r.random() < 0.8:
            attr = f' class="{self.r.choice(["zone", "c", "box", "mod", "x"])}-{self.r.choice("abkz")}{self.r.randint(1, 99)}"'
        self.out.append(f"<{tag}{attr}>")
        fill()
        self.out.append(f"</{tag}>")

    def links(self, n):
        style = self.r.random()
        self.out.append("<ul>" if style < 0.7 else "<div>")
        for _ in range(n):
            self.block("li" if style < 0.7 else "div", self.r.choice(CUES) + " " + self.label(1, 1) if self.r.random() < 0.2 else self.label(), False, True)
        self.out.append("</ul>" if style < 0.7 else "</div>")

    def ad(self):
        self.block(self.r.choice(["div", "p"]), self.sentences(3, 16), False, self.r.random() < 0.4)

    def comment(self):
        self.out.append("<div>")
        self.block("div", self.label(1, 2) + " says", False, self.r.random() < 0.5)
        self.block(self.r.choice(["p", "p", "div"]), self.sentences(2, 60), False)
        self.block("div", "Reply " + self.label(1, 1), False, True)
        self.out.append("</div>")

    def article(self):
        r = self.r
        self.block("h1", self.label(3, 10), True)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.78:
                self.block("p", self.sentences(1, 6) if r.random() < 0.2 else self.sentences(8, 110), True)
            elif kind < 0.84:
                self.block(r.choice(["h2", "h3"]), self.label(1, 6), True)
            elif kind < 0.9:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 6)):
                    self.block("li", self.sentences(1, 14) if r.random() < 0.5 else self.label(1, 6), True)
                self.out.append("</ul>")
            elif kind < 0.93:
                self.block(r.choice(["blockquote", "pre"]), self.sentences(5, 30), True)
            elif kind < 0.96:
                self.out.append("<table><tr>")
                for _ in range(r.randint(2, 5)):
                    self.block("td", self.label(1, 3), True)
                self.out.append("</tr></table>")
            else:
                self.box("ad", self.ad)

    def build(self):
        r = self.r
        if r.random() < 0.05:  # bare text
            for _ in range(r.randint(1, 4)):
                self.block("p", self.label(1, 5) if r.random() < 0.5 else self.sentences(2, 40), True)
            return
        if r.random() < 0.3:
            self.box("notice", lambda: (self.block("p", self.sentences(6, 25), False), self.block("button", "OK " + self.label(1, 1), False)))
        if r.random() < 0.7:
            self.box("top", lambda: (self.block("div", self.label(1, 3), False, True), r.random() < 0.4 and self.block("p", self.sentences(3, 12), False)))
        if r.random() < 0.9:
            self.box("nav", lambda: self.links(r.randint(3, 12)))
        if r.random() < 0.4:
            self.box("ad", self.ad)
        side = lambda: [(self.block("h3", self.label(1, 3), False), self.links(r.randint(2, 8))) if r.random() < 0.7 else (self.block("h3", self.label(1, 3), False), self.block("p", self.sentences(4, 18), False)) for _ in range(r.randint(1, 3))]
        if r.random() < 0.2:
            self.box("side", side)
        self.box("article", self.article)
        if r.random() < 0.3:
            self.box("related", lambda: self.links(r.randint(2, 6)))
        if r.random() < 0.4:
            self.box("comments", lambda: (self.block("h3", self.label(1, 1) + " comments", False), [self.comment() for _ in range(r.randint(1, 7))]))
        if r.random() < 0.35:
            self.box("side", side)
        if r.random() < 0.3:
            self.box("form", lambda: (self.block("p", self.sentences(3, 14), False), self.block("button", "Subscribe " + self.label(1, 1), False)))
        if r.random() < 0.85:
            self.box("foot", lambda: (self.block("p" if r.random() < 0.5 else "div", "© " + self.sentences(3, 12), False), r.random() < 0.5 and self.links(r.randint(2, 6))))
