"""Main text: the cut against all labellings, hand-made pages."""

import itertools
import random

import pytest

from oddledger.llm import html
from oddledger.llm.html import blocks, main_text, minimum_cut

SOUP = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>My Site</h1></header><div id="top-menu"><a href=x>Home</a> | <a href=y>News</a></div>
<div class="cookieNotice">We use cookies to improve this page. Accept?</div>
<div class="wrap"><h2>A story of rain</h2><p>Rain fell on the town for three days &amp; nights, and the river   rose slowly.
<p>Short one.<div class="ad-box">Buy now the best product in the world, cheap and good.</div>
<p>People moved their <b>things</b> upstairs, and the mayor said<br>the dam would hold.</p>
<script>var t = "</p>";</script><!-- <p>hidden words</p> -->
<div id="comments"><h3>2 comments</h3><p>I think this is a really nice story and I liked it very much.</p></div>
<form><label>Email</label><input></form></div><aside><p>Other stories that you might like to read today, perhaps.</p></aside>
<footer>&copy; 2020 Town</footer></body></html>"""


def test_hand_made_page():
    assert main_text(SOUP).split("\n") == [
        "A story of rain",
        "Rain fell on the town for three days & nights, and the river rose slowly.",
        "Short one.",
        "People moved their things upstairs, and the mayor said the dam would hold.",
    ]


def test_article_page():
    page = (
        "<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class=ad>Es be.</div>"
        "<article><h1>Es be.</h1><p><b>Es be.<br><p>Two&nbsp;words &lt;here&gt; &am</article><footer>x</footer>"
    )
    assert main_text(page) == "Es be.\nEs be.\nTwo words <here> &am"


PARAGRAPHS = [
    f"The {k} day of the journey led them over the hills, and nobody spoke of the town they had left." for k in
    ("first", "second", "third", "fourth", "fifth")
]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = '<ul class="menu"><li><a href=a>Home</a><li><a href=b>News</a></ul>'


@pytest.mark.parametrize(
    "page",
    [
        f'<body>{MENU}<div class="post type-post tag-news">{BODY}</div></body>',
        f'<body>{MENU}<div class="content-with-sidebar"><article>{BODY}</article></div></body>',
        f'<body><form id="aspnetForm">{MENU}<main>{BODY}</main></form></body>',
        f'<body><form id="aspnetForm">{MENU}<div>{BODY}</div></form></body>',
        f'<body>{MENU}<div class="page-header no-sidebar"><div id="search-result">{BODY}</div></div></body>',
        f'<body><div class="widget"><main>{BODY}</main><aside><p>{PARAGRAPHS[0]}</p></aside></div></body>',
        f'<body>{MENU}{BODY}<div id="comments"><article><p>{"I liked it a lot, really. " * 9}</p></article></div></body>',
        f'<body>{BODY}<div class="related"><p>{"Read this other story about a town by the sea. " * 3}</p></div></body>',
        f'<body>{BODY}<div style="display:none"><main><p>{PARAGRAPHS[1]}</p></main></div></body>',
    ],
)
def test_wrappers_do_not_hide_the_article(page):
    assert main_text(page).split("\n") == PARAGRAPHS


def test_cut_is_the_smallest():
    draw = random.Random(3)
    for _ in range(150):
        n = draw.randint(1, 7)
        source = [draw.choice([0, 1, 2, 5]) + draw.random() for _ in range(n)]
        sink = [draw.choice([0, 1, 2, 5]) + draw.random() for _ in range(n)]
        edges = [(a, b, draw.random() * 2) for a in range(n) for b in range(a) if draw.random() < 0.5]

        def cost(labels):
            own = sum(sink[i] if keep else source[i] for i, keep in enumerate(labels))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        got = minimum_cut(source, sink, edges)
        assert abs(cost(got) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-9


def test_broken_markup():
    for text in ("", "<", "<p", "<p>a<", "<a \"" * 500, "</p></div>", "<!--", "<script>x", "<<>>", "&#xfffffff; &#0;"):
        assert isinstance(main_text(text), str)
    assert [b.text for b in blocks("<p>one<div>two<p>three</div>four")] == ["one", "two", "three", "four"]
    assert main_text(None) == ""


def test_long_page():
    page = "<body>" + "<p>Some words that make a sentence here.</p>" * 5000
    assert main_text(page).count("\n") == 4999


def test_operator(spark, pages):
    rows = [(1, "u", SOUP), (2, None, None), (None, "v", ""), (3, "w", SOUP), (3, "w", SOUP), (2**60 + 1, "x", "<p>")]
    got = html.extract(pages(rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in got.collect()), key=str)
    want = sorted(((i or 0, u, main_text(h), len(main_text(h))) for i, u, h in rows), key=str)
    assert found == want
    assert html.extract(pages([])).count() == 0
