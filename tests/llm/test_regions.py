"""Operator 9 keeps whole articles: sibling paragraphs, several articles, wrappers named after a layout."""

import re

import pyarrow.parquet as pq
import pytest

from sparsetrack.llm import op9_html_extraction as op9
from sparsetrack.llm.op9_html_extraction import furniture, main_text

LONG = "A sentence of a paragraph that goes on without any tags in it. " * 80
SHORT = [f"Paragraph {i} of a text that goes on for a while without tags." for i in range(4)]


def lines(html):
    return main_text(html).split("\n\n")


def test_one_long_paragraph_beside_short_ones():
    for wrap in ("<body>{}</body>", "<body><div>{}</div></body>", "{}"):
        body = f"<h1>Title</h1><p>{SHORT[0]}<p>{SHORT[1]}<p>{LONG}<p>{SHORT[2]}<p>Ok."
        assert lines(wrap.format(body)) == ["Title", SHORT[0], SHORT[1], LONG.strip(), SHORT[2], "Ok."]


@pytest.mark.parametrize("tag", ["li", "td", "h1", "blockquote"])
def test_parts_are_no_regions(tag):
    assert lines(f"<body><div><p>{SHORT[0]}</p><p>{SHORT[1]}</p><{tag}>{LONG}</{tag}><p>{SHORT[2]}</p></div></body>") == [SHORT[0], SHORT[1], LONG.strip(), SHORT[2]]


def test_far_sections_of_a_long_one():
    sections = "".join(f"<div><h2>Part {i}</h2><p>{SHORT[i]}</p><p>{SHORT[i]}</p><p>{SHORT[i]}</p></div>" for i in range(3))
    got = lines(f"<body><div><a href=a>Home</a><a href=b>About</a></div><div>{sections}<div><h2>Last</h2><p>{LONG}</p></div></div></body>")
    assert got == [x for i in range(3) for x in (f"Part {i}", *[SHORT[i]] * 3)] + ["Last", LONG.strip()]


def test_two_articles_in_main():
    a, b = (f"<p>{SHORT[0]}</p>" * n for n in (6, 4))
    assert lines(f"<main><h1>Head</h1><p>Lead.</p><article>{a}</article><article>{b}</article></main>") == ["Head", "Lead."] + [SHORT[0]] * 10
    assert lines(f"<body><article>{a}</article><article>{b}</article></body>") == [SHORT[0]] * 10
    assert lines(f"<article><h1>Head</h1><div itemprop=articleBody>{a}</div></article>") == ["Head"] + [SHORT[0]] * 6


def test_small_article_beside_the_text():
    assert lines(f"<div>{''.join(f'<p>{x}</p>' for x in SHORT)}</div><article><p>Teaser, a short one.</p></article>")[:4] == SHORT


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "content-with-sidebar", "category-social", "side-by-side", "search-results", "sidebar", "banner"])
def test_wrapper_of_an_article(name):
    page = f"<div class='{name}'><{{0}}><p>{SHORT[0]}</p><p>{SHORT[1]}</p></{{0}}><div class=share>Share it</div></div>"
    assert lines(page.format("main")) == lines(page.format("article")) == SHORT[:2]


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "without_comments", "social-science"])
def test_layout_names_hide_nothing(name):
    assert lines(f"<div class='{name}'><p>{SHORT[0]}</p><p>{SHORT[1]}</p></div>") == SHORT[:2]


def test_comments_in_articles_stay_out():
    remarks = "".join(f"<article><p>Remark {i}: {x}</p></article>" for i, x in enumerate(SHORT))
    assert lines(f"<article><p>{SHORT[0]}</p></article><div id=comments>{remarks}</div>") == [SHORT[0]]
    assert lines(f"<div class=text>{f'<p>{LONG}</p>' * 2}</div><div id=comments>{remarks}</div>") == [LONG.strip()] * 2


def test_names():
    assert all(map(furniture, ["ad", "x cookie-notice", "site-footer", "Sidebar_Left", "related-posts", "ad-slot-3", "share-buttons", "widget-area", "comment-list", "site-header"]))
    assert not any(map(furniture, ["", "text", "has-sidebar", "no-sidebar", "with-comments", "two-cols-sidebar", "advice", "non-ad"]))


UNNAMED = f"""<body><div><a href=1>Home</a> <a href=2>News</a><div><a href=3>Sport and more</a></div><div><a href=4>Weather</a></div></div>
<div>Log in</div><div><h1>Title</h1>{"".join(f"<p>{x}</p>" for x in SHORT)}<p>Ok.</p></div>
<div><i>(c)</i> <b>2020</b> <i>us</i></div><div><a href=5>Terms</a></div></body>"""


def test_unnamed_furniture_falls_by_the_ratio():
    assert lines(UNNAMED) == ["Title", *SHORT, "Ok."]


def test_the_smoothed_ratio_decides(monkeypatch):
    """With another ratio the text is another one, on pages with and without an article element."""
    smoothed, page = op9.smoothed, f"<body><nav><p>Home</p></nav><article><p>{SHORT[0]}</p><p>{SHORT[1]}</p></article><footer>Us</footer></body>"
    assert lines(page) == SHORT[:2]
    monkeypatch.setattr(op9, "smoothed", lambda r: r * 0 + 1)
    assert lines(UNNAMED) != ["Title", *SHORT, "Ok."]
    monkeypatch.setattr(op9, "smoothed", lambda r: -smoothed(r))
    assert lines(page) != SHORT[:2]


@pytest.mark.parametrize("name", ["layout has-sidebar", "content-sidebar", "search-results", "related-work", "no-comments", "page-header"])
def test_wrappers_silence_no_article(name):
    for tag in ("article", "main"):
        assert lines(f"<body><nav><a href=x>Home</a></nav><div class='{name}'><{tag}><h1>Title</h1><p>{SHORT[0]}</p><p>{SHORT[1]}</p></{tag}></div><footer>Us</footer></body>") == ["Title", *SHORT[:2]]


def test_unclosed_furniture():
    assert lines(f"<body><article><h1>Title</h1><p>{SHORT[0]}</p><p>{SHORT[1]}</p></article><footer><p>Us, whoever we are") == ["Title", *SHORT[:2]]
    assert lines(f"<body><nav><ul><li><a href=a>Home</a><article><p>{SHORT[0]}</p><p>{SHORT[1]}</p></article>")[-2:] == SHORT[:2]


def test_short_lines_of_a_second_part_stay():
    verse = [f"A line of verse {i}" for i in range(6)]
    first, second = "".join(f"<p>{x * 3}</p>" for x in SHORT), "".join(f"<p>{x}</p>" for x in verse)
    for tag in ("article", "div"):
        assert lines(f"<body><nav><a href=a>Home</a></nav><div><{tag}>{first}</{tag}><{tag}>{second}</{tag}></div><footer>Us</footer></body>") == [x * 3 for x in SHORT] + verse


def test_a_list_ends_an_unnamed_text():
    assert lines(f"<body><div>Buy it now</div><h1>Title</h1>{''.join(f'<p>{x}</p>' for x in SHORT)}<ul><li>One</li><li>Two</li></ul><div>Us</div></body>") == ["Title", *SHORT, "One", "Two"]


def stripped(html, article):
    """A page whose names tell nothing."""
    html = re.sub(r"<[a-zA-Z][^>]*>", lambda tag: re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", tag[0]), html)
    return re.sub(r"<(/?)article\b[^>]*>", r"<\1div>" if article == "div" else "", html)


@pytest.mark.parametrize("article", ["div", ""])
def test_given_pages_without_names(monkeypatch, article):
    """Without ``article``, class, id and role the ratio finds the texts; a constant one doesn't."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    want, bare = [main_text(h) for h in pages], [stripped(h or "", article) for h in pages]
    assert sum(map(str.__eq__, want, map(main_text, bare))) >= 0.98 * len(pages)
    monkeypatch.setattr(op9, "smoothed", lambda r: r * 0 + 1)
    assert sum(map(str.__eq__, want, map(main_text, bare))) < 0.9 * len(pages)
