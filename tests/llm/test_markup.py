"""Broken markup, attributes and nesting in the reading of pages, and the time it takes."""

import time

import pytest

from mediaquarry.llm.htmlcut import blocks_of, main_text

ARTICLE = "<article>{}</article><footer>Imprint</footer>"


@pytest.mark.parametrize(
    "inside, want",
    [
        ("<p title=don't>FIRST one here. Second.</p><p>It's SECOND, indeed.</p>", "FIRST one here. Second. It's SECOND, indeed."),
        ("<p title=\"a > b\" data-x='c > \"d\"'>Text one, here.</p><p id=x'y\"z>Text two, here.</p>", "Text one, here. Text two, here."),
        ("<p a = 'x>y' b=\"\">One, two.</p><p 'stray\" quotes>Three, four.</p>", "One, two. Three, four."),
        ("<p>One text <b class=\"never closed>bold</b> and more.</p>", "One text bold and more."),
        ("<p>One text. <video src=x> not</p><p>Two text, here.</p>", "One text. Two text, here."),
        ("<p>One.</p><object><object>no</object>fallback</object><p>Two, three.</p>", "One. Two, three."),
        ("<p>A drawing <svg><g><svg>no</svg></g><path d='1'/><text>none</text></svg> stands here.</p>", "A drawing stands here."),
        ("<p>Sound <audio><p>no player</p></audio>and text.</p><canvas>none<p>Last, one.</p>", "Sound and text."),
        ("<p>Pick <select><option>one<option>two</select> of these.</p>", "Pick of these."),
        ("<p>Text, here. <button>Share</button></p>", "Text, here."),
        ("<p>Less: 3 < 4 and a<b>b</b>, x <3.</p>", "Less: 3 < 4 and ab, x <3."),
        ("<p>One <iframe><p>no</p></iframe>two. <textarea><b>no</textarea></p><template><p>no</p></template><p>Three.</p>", "One two. Three."),
        ("<p>One <?php echo 1 ?>two<!doctype x></ bogus> three.</p>", "One two three."),
    ],
)
def test_markup(inside, want):
    page = "<html><head><title>T</title><meta charset=utf-8></head><body>" + ARTICLE.format(inside)
    assert main_text(page) == want


def test_a_head_without_end_gives_way_to_the_body():
    assert main_text("<head><title>T</title><link rel=x><article><p>Body text, yes it is.</p></article>") == "Body text, yes it is."


HOSTILE = {
    "tags in tags": "<a " * 100_000,
    "open quote": "<p>x</p>" * 30_000 + "<p title='",
    "quotes": "<a b=\"" * 50_000,
    "mixed quotes": "<a b='\"" * 50_000,
    "comments": "<!--" * 100_000,
    "end tags of p": "<p><div>" + "<span>" * 30_000 + "</p>" * 30_000,
    "end tags of b": "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000,
    "headings": "<p><div>" + "<h1>" * 30_000,
    "videos": "<video>" * 50_000 + "</audio>" * 50_000,
    "scripts": "<script></script" * 30_000,
    "less than": "<" * 200_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_reading_takes_linear_time(name):
    began = time.process_time()
    blocks_of(HOSTILE[name])
    assert time.process_time() - began < 3
