"""Rules, links and verdicts against walks over dense matrices."""

from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import url_filter

PAGE = "<html><body><nav><a href='/a'>Home</a></nav><article><h1>Title &amp; more</h1><p>First <b>part</b>\n of it.<br><p>Second&nbsp;one has a few words.</p><script>no()</script></article><footer>&copy; x.com</footer></body></html>"
URLS = [(0, "http://a.com/x", '<a href="http://b.com/">'), (1, "http://b.com/", '<a href="http://bad.net/y">'), (2, "http://bad.net/y", None), (3, "http://c.org/fr/1", "<a href=//d.com/z>"), (4, "http://D.com", "x"), (5, None, None), (6, "nothing", ""), (7, "http://example.net/en/a?x", '<a href="http://a.com">'), (8, "HTTP://x.Example.COM/de/b#f", ""), (9, "http://net", ""), (None, "http://d.com/q", PAGE), (0, "http://a.com/x", "")]


def test_url_filter(spark):
    pages = spark.createDataFrame([(*u, 1) for u in URLS], "page_id long, url string, html string, host int")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages.drop("host")).collect())
    assert got[2, "bad.net", "/y", "net/", "block"] == 1 and got[3, "c.org", "/fr/1", "org/fr/", "allow"] == 1 and got[8, "x.example.com", "/de/b", "example.com/de/", "block"] == 1
    assert got[7, "example.net", "/en/a", "example.net/en/", "allow"] == 1 and got[9, "net", "", None, "allow"] == 1 and got[5, "", "", None, "allow"] == got[6, "", "", None, "allow"] == 1
    # b.com links to a blocked host, d.com is linked from a trusted one
    assert got[1, "b.com", "/", None, "block"] == 1 and got[4, "d.com", "", None, "allow"] == 1 and sum(got.values()) == len(URLS)
    assert url_filter.judge_urls(pages.drop("host").limit(0)).collect() == []


def test_spread_is_personalised_page_rank(spark):
    links = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 5)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 0.5), ("trust", "d", 0.5), ("distrust", "c", 1.0)], "kind string, host string, mass double")
    got = {(r["kind"], r["host"]): r["score"] for r in url_filter.spread(links, seeds, tolerance=1e-9, rounds=60).collect()}
    names, w = "abcd", np.zeros((4, 4))
    for s, d, n in links.collect():
        w[names.index(s), names.index(d)] = n
    for kind, m, seed in (("trust", w, np.array([0.5, 0, 0, 0.5])), ("distrust", w.T, np.array([0, 0, 1.0, 0]))):
        x = seed
        for _ in range(200):
            out = m.sum(axis=1)
            step = np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)
            x = 0.15 * seed + 0.85 * (x @ step + x[out == 0].sum() * seed)
        assert np.allclose([got.get((kind, n), 0.0) for n in names], x, atol=1e-4)


def test_spread_ends_at_the_tolerance(spark):
    # two hosts that pass all back and forth: 30 rounds do not get below 1e-10
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, mass double")
    got = {r["host"]: r["score"] for r in url_filter.spread(links, seeds, damping=0.5, tolerance=1e-10).collect()}
    assert abs(got["a"] - 2 / 3) < 1e-10 and abs(got["a"] + got["b"] - 1) < 1e-9


def links_of(spark, html, host="a.com"):
    pages = spark.createDataFrame([(host, html)], "host string, html string")
    return sorted((r["dst"], r["n"]) for r in url_filter.host_links(pages).collect())


def test_links_are_those_of_anchors(spark):
    assert links_of(spark, '<A class=x HREF = "http://B.com/1">x</A><a href=//c.com><a href="http://b.com"><a href="/x"><a href="http://a.com/2">') == [("b.com", 2), ("c.com", 1)]
    assert links_of(spark, '<a data-href="http://no.com/"><area href="http://no.com"><abbr href="http://no.com"><!-- <a href="http://no.com"> --><script>"<a href=\'http://no.com\'>"</script><a href="http://d.com">') == [("d.com", 1)]
    assert links_of(spark, '<!-- <a href="http://no.com">') == []
    assert links_of(spark, "<a " * 20_000 + '<a href="http://e.com">') == [("e.com", 1)]


def walk(m, seed):
    out, x = m.sum(axis=1), seed
    step = np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)
    for _ in range(300):
        x = 0.15 * seed + 0.85 * (x @ step + x[out == 0].sum() * seed)
    return x


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_are_those_of_dense_walks(spark, seed):
    r = np.random.default_rng(seed)
    hosts = [f"h{k}.com" for k in range(24)] + [f"x{k}.net" for k in range(4)] + [f"y{k}.org" for k in range(4)]
    m = np.zeros((len(hosts), len(hosts)))
    pages = []
    for i, h in enumerate(hosts):
        for _ in range(int(r.integers(1, 4))):
            to = [int(k) for k in r.integers(0, len(hosts), int(r.integers(0, 4)))]
            for k in to:
                m[i, k] += k != i
            path = "/fr/" if h.endswith("org") else "/"
            pages.append((len(pages), f"http://{h}{path}{len(pages)}", "".join(f'<a href="http://{hosts[k]}/">' for k in to)))
    seeds = [np.array([sum(u.startswith(f"http://{h}/") and h.endswith(end) for _, u, _ in pages) for h in hosts], float) for end in ("org", "net")]
    good, bad = walk(m, seeds[0] / seeds[0].sum()), walk(m.T, seeds[1] / seeds[1].sum())
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    for x in got:
        k = hosts.index(x["host"])
        if x["rule"]:
            assert x["verdict"] == ("block" if x["host"].endswith("net") else "allow")
        elif abs(bad[k] - good[k]) > 1e-3:
            assert x["verdict"] == ("block" if bad[k] > good[k] else "allow"), x
    assert {x["verdict"] for x in got if not x["rule"]} == {"allow", "block"}
