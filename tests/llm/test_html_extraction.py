"""Scanning of pages, and main text on pages labelled by hand: main blocks begin with a mark."""

import time

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import html_extraction as he

MARK = "\ue000"

#: templates unlike those of the page maker; «M» begins a main block
BY_HAND = [
    """<!doctype html><html><head><title>t</title><style>.a{}</style></head><body class="single post-template"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><a href="/">Green Kitchen</a><p class="site-description">Recipes from the north</p></header><nav class="main-navigation"><ul><li><a href="/a">Home</a></li><li><a href="/b">Soups</a></li><li><a href="/c">About me</a></li></ul></nav><div id="content" class="site-content"><main id="main"><article class="post hentry"><h1 class="entry-title">«M»Lentil soup for cold evenings</h1><div class="entry-content"><p>«M»Rinse the lentils until the water runs clear, then chop two onions as finely as you can manage.</p><p>«M»Fry the onions slowly. They should be golden, not brown, before the lentils go in.</p><h2>«M»What you need</h2><ul><li>«M»250 g of red lentils</li><li>«M»Two onions, some oil</li></ul><p>«M»Simmer for twenty minutes and season at the very end.</p></div></article><div id="comments" class="comments-area"><h2>3 thoughts on this recipe</h2><ol class="comment-list"><li class="comment"><p>Lovely, thank you! I made it last night and the children asked for more.</p></li><li class="comment"><p>Mine burned.</p></li></ol></div></main><aside id="secondary" class="widget-area"><section class="widget"><h3>Recent posts</h3><ul><li><a href="/1">Rye bread</a></li><li><a href="/2">Pickled beets</a></li></ul></section></aside></div><footer class="site-footer"><p>Powered by a blog engine</p></footer></div></body></html>""",
    """<html><body><div class="topbar"><a href="/">Daily Harbour</a> <a href="/politics">Politics</a> <a href="/sport">Sport</a></div><div class="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept all</button></div><main><article><h1>«M»Ferry line to close after forty years</h1><p class="byline">«M»By Anna Holm, 3 May</p><p>«M»The ferry that has linked the two shores since 1984 will make its last crossing in autumn, the company said on Monday.</p><div class="ad">Advertisement</div><p>«M»Passenger numbers have fallen by half in ten years. A bridge further north takes most of the traffic now.</p><blockquote><p>«M»"We held on for as long as we could," the captain told reporters.</p></blockquote><figure><img src="x.jpg"><figcaption>«M»The ferry at dusk.</figcaption></figure><p>«M»The council will decide in June whether to run a smaller boat.</p></article></main><div class="related"><h3>Read more</h3><ul><li><a href="/x">Bridge toll rises again</a></li><li><a href="/y">Harbour museum opens</a></li></ul></div><form class="newsletter"><label>Email</label><input><button>Subscribe</button></form><footer>&copy; Daily Harbour. All rights reserved.</footer></body></html>""",
    """<HTML><BODY><TABLE width=100%><TR><TD colspan=2><A HREF="index.html">Home</A> | <A HREF="links.html">Links</A> | <A HREF="guest.html">Guestbook</A></TD></TR><TR><TD><H1>«M»Restoring an old wooden radio</H1><P>«M»I found this set in the attic of my grandfather's house in 1997 and it took me a whole winter to bring it back.<P>«M»The first step was to replace every capacitor. None of the old ones could be trusted, and two had leaked over the chassis.<P>«M»After that the dial cord had to be made anew from fishing line.</TD></TR></TABLE></BODY></HTML>""",
    """<body><nav class="navbar"><a href="#">Docs</a><a href="#">API</a><a href="#">Blog</a></nav><div class="container"><div class="sidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li><li><a href="#c">Deploy</a></li></ul></div><div class="content"><h1>«M»Configure the server</h1><p>«M»The server reads its settings from one file when it starts. Unknown keys are reported and ignored.</p><pre>«M»port = 8080</pre><h2>«M»Limits</h2><table><tr><th>«M»Key</th><th>«M»Meaning</th></tr><tr><td>«M»workers</td><td>«M»how many requests run at a time</td></tr></table><p>«M»Changes take effect after a restart.</p></div></div><footer><ul><li><a href="/legal">Legal</a></li><li><a href="/status">Status</a></li></ul></footer></body>""",
    """<html><body><div id="header"><h2>River Walkers Club</h2></div><div id="menu"><ul><li><a href="/">Start</a></li><li><a href="/walks">Walks</a></li></ul></div><div id="main"><h1>«M»Spring walk along the upper river</h1><p>«M»We meet at nine at the old mill and walk upstream for about four hours, with a long break at the weir.</p><p>«M»Bring boots: the meadows are wet until May. Dogs are welcome on a lead.</p><p>«M»Afterwards there is soup for everyone at the mill.</p></div><div id="footer"><p>River Walkers Club, founded 1961</p></div></body></html>""",
    """<body><header><h1>Quiet Pages</h1></header><article class="story"><h2>«M»The lighthouse keeper's cat</h2><p>«M»Nobody knew how the cat had come to the island. It was simply there one morning, asleep on the warm stones below the lamp.</p><p>«M»The keeper, who spoke to no one, spoke to the cat.</p><p>«M»When the light was made automatic he left, but the cat stayed.</p></article><section class="comments"><h3>Comments</h3><div class="comment"><p>What a fine ending. I have read it three times now and still think of that cat.</p></div><div class="comment"><p>More please!</p></div></section><aside class="promo"><p>Buy the book today and save twenty per cent.</p></aside><footer><p>Imprint and privacy</p></footer></body>""",
]


def labelled(page):
    blocks = he.leaves(page.replace("«M»", MARK))
    labels = [MARK in b.text for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MARK, "")
    return blocks, labels


def shares(pages, chain):
    """Precision and recall by characters."""
    hit = found = main = 0
    for blocks, labels in pages:
        for b, wanted, got in zip(blocks, labels, chain.decode(blocks), strict=True):
            hit, found, main = hit + len(b.text) * (wanted and got), found + len(b.text) * got, main + len(b.text) * wanted
    return hit / found, hit / main


def test_pages_labelled_by_hand():
    precision, recall = shares([labelled(p) for p in BY_HAND], he.default_chain())
    print("by hand: precision", precision, "recall", recall)
    assert precision > 0.9
    assert recall > 0.9


def test_new_pages_of_the_maker():
    maker = he.PageMaker(4242)
    precision, recall = shares([maker.page() for _ in range(200)], he.default_chain())
    print("page maker: precision", precision, "recall", recall)
    assert precision > 0.97
    assert recall > 0.98


def test_viterbi_is_the_best_of_all_paths():
    chain = he.default_chain()
    blocks, _ = labelled(BY_HAND[5])
    blocks = blocks[:9]
    m, best = len(blocks), None
    scores = [sum(chain.weights.get(f, 0.0) for f in he.features(b, i, m)) for i, b in enumerate(blocks)]
    for path in range(1 << m):
        states = [path >> i & 1 for i in range(m)]
        total = chain.starts[states[0]] + sum(s * x for s, x in zip(scores, states, strict=True))
        total += sum(chain.moves[a][b] for a, b in zip(states[:-1], states[1:], strict=True))
        if best is None or total > best[0]:
            best = total, states
    assert chain.decode(blocks) == best[1]


def texts(page):
    return [b.text for b in he.leaves(page)]


@pytest.mark.parametrize("tag", ["svg", "object", "canvas", "audio", "video", "template"])
def test_skipped_elements_end_where_they_should(tag):
    assert texts(f"<body><div>a<{tag} x=1>no</div><p>b</p></body>") == ["a", "b"]
    assert texts(f"<body><p>a<{tag}>no<p>b") == ["a", "b"]
    assert texts(f"a<{tag}>no<p>b") == ["a", "b"]
    assert texts(f"<div>a <{tag}><p>no</p><{tag}>no</{tag}><script></{tag}></script></{tag}> b</div>c") == ["a b", "c"]


def test_formulas_and_text_for_readers_without_scripts_stay():
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>") == ["if x=2 then"]
    assert texts("<body><noscript><p>a</p></noscript><p>b</p>") == ["a", "b"]


def test_an_article_in_noscript_is_found():
    blocks, labels = labelled(BY_HAND[4].replace('<div id="main">', '<noscript><div id="main">').replace('mill.</p></div>', 'mill.</p></div></noscript>'))
    got = he.default_chain().decode(blocks)
    assert sum(a == b for a, b in zip(got, labels, strict=True)) >= len(labels) - 1


def test_markup_without_end():
    assert texts("a<script>no<p>no") == ["a"]
    assert texts("a<!-->b<!--x-->c<!doctype x>d<![CDATA[no]]>e") == ["abcde"]
    assert texts('<a title="x>y">t</a><p class=a>q</p><img alt=">"/>z') == ["t", "q", "z"]
    assert texts('<p>a</p><a x="b>c<p>d</p>') == ["a", "c", "d"]
    assert texts("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]


HOSTILE = {
    "quotes": "<a " + '"' * 10_001 + "</a><p>x",
    "values": '<a ="' * 20_000,
    "starts": "<a" * 100_000,
    "hidden ends": "<a ='>' " * 60_000,
    "media": "<p><video>" * 30_000,
    "deep": "<div class=a>" * 30_000 + "x",
    "names": "".join(f'<div class="{chr(97 + i % 26) * (i % 50 + 1)}">x' for i in range(10_000)),
    "stray ends": "<div>" * 20_000 + "</p>" * 20_000,
    "references": "&" * 100_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_in_proportion(name):
    chain = he.default_chain()
    began = time.time()
    he.main_text(HOSTILE[name], chain)
    assert time.time() - began < 5


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text int, n_chars string, names string"
    page = "<article><h1>Title</h1><p>A&amp;B &lt;c&gt;  d\n e&#x41; of the day.</p></article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "no markup"), (None, None, page), (4, "u", page), (4, "u", page), (5, "u", "<article>" + "<p>word word word.</p>" * 20_000 + "</article>")]
    got = he.extract(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema).repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r["page_id"] or 0, r["text"][:40], r["n_chars"]) for r in got.collect())
    assert [(a, c) for a, _, c in found if a in (1, 2)] == [(1, 0), (2, 0)]
    assert [t for a, t, _ in found if a in (0, 4)] == ["Title A&B <c> d eA of the day."] * 3
    assert found[-1][2] == 20_000 * 15 + 19_999
    assert he.extract(spark.createDataFrame([], schema)).filter(F.col("page_id").isNotNull()).collect() == []
