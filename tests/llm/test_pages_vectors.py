"""Operators on pages and vectors against brute force and exact round trips."""

import base64
import hashlib
import math
import os
import random
import time
from datetime import datetime, timedelta
from itertools import product

import pytest

from mediaquarry.llm import htmlcut, rpforest, urlfilter, warc
from mediaquarry.llm.common import Scratch

from .fixtures import prose
from .labelled import Page

PAGES = "page_id long, url string, html string, text string, n_chars string, host string"

# main text ------------------------------------------------------------------

BODY = "<h1>Real title</h1><p>Short.</p><p>This is a paragraph with enough words to be content, really &amp; truly.</p><p>Second one with <a href=y>a link</a> in&nbsp;it &lt;b&gt;.</p>"
TEXT = "Real title Short. This is a paragraph with enough words to be content, really & truly. Second one with a link in it <b>."
AROUND = [
    "<nav><ul><li><a href=1>Home</a><li><a href=2>About us</a></ul></nav>",
    "<header><h2>The site's name</h2><p>A slogan that is long enough to look like a sentence of its own.</p></header>",
    "<footer><p>All rights reserved by the owners of this site, whoever they are.</p></footer>",
    "<aside class=x><h3>Popular</h3><p>Something that other people have read with joy, they say.</p></aside>",
    '<div class="sidebar-left"><p>Something that other people have read with joy, they say.</p></div>',
    '<div id="cookieNotice">We use cookies. Accept them please, thank you very much for your time.</div>',
    '<div class="ad">Buy now! Great deals on everything, only today, so hurry up and come.</div>',
    "<form><p>Subscribe to our letter, which is full of wonderful things.</p><input><button>Go</button></form>",
    '<section class="comments"><h2>Comments</h2><p>I think this article is really great, and more people should read it every day.</p></section>',
    "<script>var t='<p>Not a paragraph, however long it may be, not at all.</p>';</script><style>p{color:red}</style><!-- <p>a comment</p> -->",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><div class="post-body">{}</div></div>'])
@pytest.mark.parametrize("k", range(len(AROUND)))
def test_furniture_goes(wrap, k):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{AROUND[k]}{wrap.format(BODY)}{AROUND[(k + 3) % len(AROUND)]}</body></html>"
    assert htmlcut.main_text(page) == TEXT


def test_furniture_inside_the_article():
    for part in AROUND[4:9]:
        assert htmlcut.main_text(f"<body><article>{BODY}{part}<p>And a last paragraph that ends the article well.</p></article></body>") == TEXT + " And a last paragraph that ends the article well."


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("<!-- never closed <p>x", ""), ("<p>a b<script>never closed", "a b"), ("<p>unclosed <b>x", "unclosed x"), ("<article><p>a &lt; b &#233;&eacute; <br>c<p>d</b></i>e</article></p>", "a < b éé c de"), ("<article>1 < 2 and <3></article>", "1 < 2 and <3>")])
def test_odd_markup(html, text):
    assert htmlcut.main_text(html) == text


def test_cut_is_least():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 9)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        ties = {(i, j): r.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        cost = lambda lab: sum(max(0, -o) if x else max(0, o) for o, x in zip(odds, lab)) + sum(c for (i, j), c in ties.items() if lab[i] != lab[j])  # noqa: B023, E731
        assert cost(htmlcut.min_cut(odds, ties)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


def judged(seeds, style=None):
    out = []
    for seed in seeds:
        page = Page(seed, style)
        blocks, tree = htmlcut.blocks_of(page.html)
        assert [b.text for b in blocks] == [t for t, _ in page.labels]
        odds = [htmlcut.log_odds(b) for b in blocks]
        out.append(([o > 0 for o in odds], htmlcut.min_cut(odds, htmlcut.ties_of(blocks, tree)), [g for _, g in page.labels]))
    return out


@pytest.mark.parametrize("style,alone,cut,whole", [("tags", 0.95, 0.99, 0.95), ("names", 0.99, 0.99, 0.95), ("mute", 0.85, 0.97, 0.65)])
def test_the_cut_decides(style, alone, cut, whole):
    """Share of blocks labelled rightly by the classifier alone and by the cut; share of pages wholly right."""
    pages = judged(range(5000, 5200), style)
    n = sum(len(g) for _, _, g in pages)
    by_odds = sum(x == y for o, _, g in pages for x, y in zip(o, g)) / n
    by_cut = sum(x == y for _, c, g in pages for x, y in zip(c, g)) / n
    right = sum(c == g for _, c, g in pages) / len(pages)
    assert by_odds > alone and by_cut > cut and right > whole
    assert by_cut > by_odds and right > sum(o == g for o, _, g in pages) / len(pages)
    if style == "mute":
        assert by_cut - by_odds > 0.05


def test_flow_runs(monkeypatch):
    ran, flow = [], htmlcut._flow
    monkeypatch.setattr(htmlcut, "_flow", lambda odds, near: ran.append(len(odds)) or flow(odds, near))
    judged(range(5000, 5200))
    assert len(ran) >= 20


def test_weights_are_those_fitted():
    pages = []
    for seed in range(1500):
        page = Page(seed)
        pages.append((htmlcut.blocks_of(page.html)[0], [g for _, g in page.labels]))
    assert [round(float(w), 2) for w in htmlcut.fit(pages)] == pytest.approx(htmlcut.WEIGHTS, abs=0.011)


LONG = "".join(f"<p>{prose(k, 60)}</p>" for k in range(4))


def test_names_that_say_nothing_or_mislead():
    text = " ".join(prose(k, 60) for k in range(4))
    reader = lambda k: f'<div class="x{k}"><div><a href=u{k}>kab{k} oplin</a></div><p>{prose(50 + k, 14)}</p><div><a href=r{k}>Reply</a></div></div>'
    assert htmlcut.main_text(f'<body><div class="c-9">{LONG}</div><div class="c-4">{reader(1)}{reader(2)}{reader(3)}</div></body>') == text
    law = LONG.replace("<p>", '<p class="copyright-law">', 1)
    assert htmlcut.main_text(f"<article>{law}</article>") == text
    assert htmlcut.main_text(f"<article><p>Let <math><mi>x</mi></math> be 3.</p>{LONG}</article>") == "Let x be 3. " + text
    links = "".join(f"<div><a href=/{k}>{prose(70 + k, 5)}</a></div>" for k in range(4))
    assert htmlcut.main_text(f'<body><div class="zone-b7">{links}</div><div class="zone-b8">{LONG}</div><div class="zone-b9">{links}</div></body>') == text


@pytest.mark.parametrize("html", ["<div>x" * 20_000, "<b>y" * 20_000, "<div><p>z</section>" * 20_000, "<option>o" * 20_000, "<head>h" * 20_000, "<ul><li><a href=x>k</a> and so on" * 10_000, "<div><b>" * 20_000 + "</i></div>" * 20_000])
def test_parsing_takes_linear_time(html):
    began = time.process_time()
    htmlcut.main_text(html)
    assert time.process_time() - began < 5


def test_extract_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x", "y", "z"), (2, None, None, None, None, None), (None, "u", "", None, None, None), (1, "u", f"<article>{BODY}</article>", "x", "y", "z"), (4, "u", "<article><p>" + prose(1, 50_000) + "</article>", None, None, None)]
    got = htmlcut.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert [(r.page_id, r.url, r.text[:9], r.n_chars) for r in got[:4]] == [(1, "u", "Real titl", len(TEXT)), (2, None, "", 0), (None, "u", "", 0), (1, "u", "Real titl", len(TEXT))]
    assert got[4].text == prose(1, 50_000)
    assert htmlcut.extract_text(spark.createDataFrame([], PAGES)).count() == 0


# archives -------------------------------------------------------------------

EVIL = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nend WARC/1.1\r\n"


@pytest.mark.parametrize("split", ["128m", "6000", "changing"])
def test_archive_round_trip(spark, split, monkeypatch):
    html = lambda i: EVIL * (i % 5 + 1) + str(i) + "é" * (i % 50) if i % 3 else "dup" if i % 2 else None
    rows = [(i, f"http://a/{i}" if i % 9 else None, html(i), "t", "n", "h") for i in range(120)] + [(None, "http://x\r\n/", "no id", None, None, None)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(2)
    path = Scratch(spark, "archive").fresh("warc")
    warc.write_warc(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000" if split == "changing" else split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    if split == "changing":  # the cluster changes behind each step

        class Changing(Scratch):
            def write(self, df, name):
                out = super().write(df, name)
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(3000 + 1700 * self._n))
                return out

        monkeypatch.setattr(warc, "Scratch", Changing)
    try:
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(rows) and all(r.intact for r in got)
    by, first = {r.record_id: r for r in got}, {}
    for i, _, h, *_ in sorted(rows[:-1]):
        first.setdefault((h or "").encode(), i)
    for i, url, h, *_ in rows[:-1]:
        h, r = (h or "").encode(), by[f"<urn:page:{i}>"]
        assert r.digest == "sha1:" + base64.b32encode(hashlib.sha1(h).digest()).decode() and r.http_bytes == len(h) and r.url == url
        if first[h] == i:
            assert r.type == "response" and bytes(r.payload) == h and r.refers_to is None
        else:
            assert r.type == "revisit" and r.refers_to == f"<urn:page:{first[h]}>" and not r.payload
    assert by[None].url == "http://x%0D%0A/" and bytes(by[None].payload) == b"no id"


def test_damaged_and_empty_archives(spark):
    path = Scratch(spark, "archive").fresh("warc")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.read_warc(spark, path).count() == 0
    good = "WARC/1.1\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    text = good.format(1) + good.format(2) + "WARC/1.1\r\nContent-Length: junk\r\n\r\nxx\r\n\r\n" + good.format(4)
    path = Scratch(spark, "archive").fresh("warc")
    spark.createDataFrame([(text,)], "value string").write.option("lineSep", "\n").text(path)
    assert {r.record_id for r in warc.read_warc(spark, path).collect()} == {"<urn:page:1>", "<urn:page:2>"}


def test_other_archives(spark):
    """WARC/1.0, gzip (a member a record), HTTP headers beyond 64 KB, and a file that is cut short in reading."""
    import gzip

    record = lambda v, k, block: (f"WARC/1.{v}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    blocks = [b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 100_000 + b"\r\n\r\n" + bytes(range(256)) * 9, b"HTTP/1.1 200 OK\r\n\r\nsee WARC/1.1\r\nContent-Length: 1\r\n\r\nz\r\n\r\nWARC/1.0", b"HTTP/1.1 204 OK\r\n\r\n"]
    for kind in ("plain", "gz"):
        folder = Scratch(spark, "archive").fresh("warc")[len("file:"):]
        os.makedirs(folder)
        with open(f"{folder}/a.warc{'.gz' if kind == 'gz' else ''}", "wb") as f:
            for k, b in enumerate(blocks):
                raw = record(k % 2, k, b)
                f.write(gzip.compress(raw) if kind == "gz" else raw)
        got = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, f"file:{folder}").collect()}
        assert got == {f"<urn:page:{k}>": b.split(b"\r\n\r\n", 1)[1] for k, b in enumerate(blocks)}


# url filters ----------------------------------------------------------------


def test_temporal_filter(spark):
    day = lambda k: datetime(2024, 1, 1) + timedelta(days=k)
    events = [
        ("spam", "host", "A.example", "add", day(1)), ("spam", "host", "A.example", "remove", day(10)), ("spam", "host", "A.example", "add", day(20)),
        ("adult", "domain", "example", "add", day(5)), ("adult", "domain", "b.example", "add", day(2)), ("adult", "domain", "b.example", "remove", day(2)),
        ("robots", "prefix", "b.example/private/", "add", day(0)), ("robots", "prefix", None, "add", day(0)), ("robots", "host", "c.org", "add", None),
    ]
    urls = ["http://a.example/x", "https://u:p@A.EXAMPLE.:8080/", "http://b.example/private/a?q=/", "http://sub.b.example", "http://b.example/privateer", "http://bexample/", "http://c.org/", "junk", "", None]
    caps = [(i, u, day(t) if t is not None else None, "x", "y") for i, (u, t) in enumerate(product(urls, [0, 1, 2, 9, 10, 19, 30, None]))] * 2
    df = spark.createDataFrame(caps, "page_id long, url string, fetched_at timestamp, host string, row string")
    ev = spark.createDataFrame(events, "list string, kind string, pattern string, action string, at timestamp")
    valid = [("spam", "host", "a.example", 1, 10), ("spam", "host", "a.example", 20, 10**6), ("adult", "domain", "example", 5, 10**6), ("robots", "prefix", "b.example/private/", 0, 10**6)]

    def model(u, at):
        if not u or "://" not in u or at is None:
            return 0, ""
        host, _, path = u.split("://")[1].partition("/")
        host, path = host.split("@")[-1].split(":")[0].lower().rstrip("."), "/" + path.split("?")[0]
        t = (at - datetime(2024, 1, 1)).days
        hit = [v for v in valid if v[3] <= t < v[4] and (host == v[2] if v[1] == "host" else host == v[2] or host.endswith("." + v[2]) if v[1] == "domain" else (host + path).startswith(v[2]))]
        return len(hit), ",".join(sorted({v[0] for v in hit}))

    got = urlfilter.judge(df, ev).collect()
    assert len(got) == len(caps)
    for r in got:
        assert (r.n_entries, r.lists) == model(r.url, r.fetched_at) and r.blocked == (r.n_entries > 0), r
    assert urlfilter.judge(df, ev.limit(0)).filter("blocked").count() == 0 and urlfilter.judge(df.limit(0), ev).count() == 0


# vectors --------------------------------------------------------------------


def vectors(n=500, dim=24, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 and out:
            base = out[r.randrange(max(1, len(out) // 4))][1]
            noise = r.choice([0, 0.02, 0.05, 0.08, 0.12])
            out.append((i, [x + r.gauss(0, noise) for x in base], i % 7))
        else:
            out.append((i, [r.gauss(0, 1) for _ in range(dim)], i % 7))
    return out


def brute_links(rows, least):
    import numpy as np

    unit = {}
    for i, v, *_ in rows:
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    links = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and float(unit[i] @ unit[j]) >= least} for i in unit}
    parent = {i: i for i in links}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, js in links.items():
        for j in js:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(js), find(i)) for i, js in links.items()}


@pytest.mark.parametrize("leaf,block,sample", [(32, 16, 20_000), (48, 512, 200)])
def test_forest_recall(spark, leaf, block, sample):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.9, leaf=leaf, block=block, sample=sample, spill=0.05).collect()}
    want = brute_links(rows, 0.9)
    total = sum(n for n, _ in want.values())
    assert total > 500 and sum(n for n, _ in got.values()) >= 0.98 * total
    assert all(got[i][0] <= want[i][0] for i in want)


def test_forest_recall_as_shipped(spark):
    """Production parameters, 64 dimensions, links just above the threshold: cosines of .9 to .95."""
    import numpy as np

    r, rows = np.random.default_rng(3), []
    for i in range(1200):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        rows.append((3 * i, a.tolist(), 0))
        for k in (1, 2):
            b = r.normal(size=64)
            b -= (b @ a) * a
            c = r.uniform(0.901, 0.95)
            rows.append((3 * i + k, (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 0))
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute_links(rows, 0.9)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)


def test_links_are_counted_once(spark):
    """Many vectors of one spot share leaves in all trees and in several blocks: each link counts once."""
    r = random.Random(4)
    spot = [r.gauss(0, 1) for _ in range(16)]
    rows = [(i, [x + r.gauss(0, 0.01) for x in spot], 0) for i in range(90)] + [(i, [r.gauss(0, 1) for _ in range(16)], 0) for i in range(90, 150)] + [(200 + i, spot, 0) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=20, block=16).collect()}
    want = brute_links(rows, 0.9)
    assert {i: got[i] for i in want} == want


def test_forest_edges(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 0), (3, None, None), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 0.0], 1), (6, [float("nan"), 1.0, 0.0], 1), (7, [], 1), (8, [1.0, 0.0], 1), (9, [0.9, 0.1, 0.0], 2), (9, [0.9, 0.1, 0.0], 2), (10, [1e-200, 0.0, 0.0], 2), (11, [1e300, 1e299, 0.0], 2), (12, [0.0, 0.0, 1.0], 3), (13, [float("inf"), 0.0, 0.0], 3), (14, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, "k") for r in [*rows, (None, [1.0, 0.0, 0.0], 0)]], "vec_id long, embedding array<double>, label int, id long, raw string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_duplicates(df, 0.9).collect()}
    near = [1, 2, 9, 10, 11, 14]
    assert got.pop(None) == (0, None)
    assert got == {**{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 12, 13)}, **{i: (5, 1) for i in near}}
    assert rpforest.near_duplicates(df.limit(0), 0.9).count() == 0
