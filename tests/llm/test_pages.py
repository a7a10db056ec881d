"""URL filter and HTML extraction."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import html_text, url_filter

SCHEMA = "page_id long, url string, html string, extra string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], SCHEMA).withColumnRenamed("extra", "host")


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://A.Example.COM/en/5?q=/x#y", None), (2, "https://www.example.com/en/77", ""), (3, "http://xexample.net/de/8", ""), (4, "http://example.net/de/81", ""),
        (5, "http://b.org/es/", ""), (6, "b.org/es/", ""), (7, None, ""), (8, "http://com?x", ""), (9, "http://b.org/es", ""), (9, "http://b.org/es", ""),
    ]
    got = sorted(tuple(r) for r in url_filter.judge(pages(spark, rows)).collect())
    assert got == [
        (1, "a.example.com", "/en/5", "com/en/", "block"), (2, "www.example.com", "/en/77", "example.com/en/7", "allow"), (3, "xexample.net", "/de/8", "net/de/", "block"),
        (4, "example.net", "/de/81", "example.net/de/8", "block"), (5, "b.org", "/es/", "org/es/", "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "com", "", None, "allow"), (9, "b.org", "/es", None, "allow"), (9, "b.org", "/es", None, "allow"),
    ]
    assert url_filter.judge(pages(spark, rows).limit(0)).count() == 0


def test_equivalence_carries_blocks(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://s.com/en/1", ""), (2, "http://mirror.xyz/a", link.format("http://s.com/en/1")), (3, "http://alias.xyz/b#f", '<meta http-equiv="refresh" content="0; url=http://mirror.xyz/a">'),
        (4, "http://other.xyz/", link.format("/home")), (5, "http://t.com/en/2", ""), (6, "http://example.com/en/7", ""),
        (7, "http://both.xyz/", link.format("http://t.com/en/2") + '<meta http-equiv=refresh content="1;url=http://example.com/en/7">'), (8, "http://alias.xyz/b", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "block"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="comments-open">
<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div><article class="post"><h1>Title &amp;  more</h1>
<p>First <b>bold</b> line<br>second.<p>Unclosed &lt;tag&gt;&nbsp;here<!-- no <p> --><div class="ad">Buy</div><aside>Side</aside><form><p>Mail</p></form>
<ul><li>One</li><li>Two</li></ul><section id="comments"><article><p>Reader says</p></article></section></article><div class="sidebar">Bar</div><footer>&copy; me</footer>"""


def test_zones():
    parts = html_text.blocks(PAGE)
    assert html_text.article(parts) == ["Title & more", "First bold line second.", "Unclosed <tag> here", "One", "Two"]
    assert html_text.blocks("") == [] and html_text.blocks("plain < text") == [(0, "plain < text")]


def test_long_and_broken_pages_take_linear_time():
    import time

    n = 40_000
    cases = ["<div>" * n + "x" + "</p>" * n, "<! " * n, '<a "' * n, "<a '\"" * n, "<a " * n + '"x" ' * n, "<!--" * n, "<script>" * n, "</b>" * n, "<p>" * n + "</div>" * n, "<i>" * n + "</b>" * n, "<" * n]
    for page in cases:
        began = time.time()
        html_text.blocks(page * 2)
        assert time.time() - began < 4, page[:20]
    assert html_text.blocks("<p>" + "a b " * 300_000) == [(0, "a b " * 299_999 + "a b")]


def test_slices_of_equal_rows(spark, monkeypatch):
    """Rows of one page_id and text are one page, in one slice or several."""
    line = "all of these words stand together on a page that was stored two times"
    rows = [(1, "http://h.com/1", f"<div>{line}</div>")] * 2 + [(i, f"http://h.com/{i}", f"<div>page {i} has words of its own, number {i * 7}</div>") for i in range(2, 14)]
    for size in (1 << 20, 60):
        monkeypatch.setattr(html_text, "SLICE", size)
        got = [r["text"] for r in html_text.main_text(pages(spark, rows)).collect()]
        assert got.count(line) == 2 and all(got)


def test_boilerplate_by_host(spark, monkeypatch):
    rng = random.Random(3)
    w = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"]) + str(rng.randrange(99)) for _ in range(n))
    shared = "this long line of the site is the same on every single page of it"
    rows = [(i, f"http://h.com/{i}", f"<body><div>{shared}</div><div>own {w(20)}</div></body>") for i in range(12)]
    rows += [(50, "http://h.com/x", PAGE), (51, None, None), (52, "http://k.com/", f"<p>{shared}</p>"), (53, "http://k.com/2", "<article></article>")]
    for size in (1 << 20, 300):  # one slice, then several a host
        monkeypatch.setattr(html_text, "SLICE", size)
        got = {r["page_id"]: r for r in html_text.main_text(pages(spark, rows)).collect()}
        assert len(got) == 16 and all(got[i]["text"].startswith("own ") and "\n" not in got[i]["text"] for i in range(12))
        assert got[50]["text"].startswith("Title & more\n\nFirst") and got[51]["text"] == "" and got[52]["text"] == shared and got[53]["text"] == ""
        assert got[50]["n_chars"] == len(got[50]["text"])
    assert html_text.main_text(pages(spark, rows).limit(0)).count() == 0


def test_copies_and_articles_survive(spark, monkeypatch):
    menu = "this long line of the site is the same on every single page of it"
    body = "the story " + " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"http://h.com/{i}", f"<div>{menu}</div><div>{body}</div>") for i in (1, 2, 3)]
    rows += [(9, "http://h.com/9", f"<div>{menu}</div><div>other words only here and never at any other place</div>")]
    rows += [(20, "http://k.com/", "<article><p>First one</p></article><nav>Menu</nav><article><p>Second, longer one</p></article>")]
    for size in (1 << 20, 100):  # one slice, then several a host
        monkeypatch.setattr(html_text, "SLICE", size)
        got = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}
        assert got == {1: body, 2: body, 3: body, 9: "other words only here and never at any other place", 20: "First one\n\nSecond, longer one"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(s):
    a = np.array(s)
    order = html_text.suffix_array(a).tolist()
    assert order == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = html_text.common_prefixes(a, np.array(order), 5).tolist()
    for i, j, n in zip(order, order[1:], lcp):
        k = 0
        while k < 5 and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        assert n == k


def test_repeated_windows():
    run = html_text.RUN
    a, b = [f"t{i}" for i in range(30)], [f"u{i}" for i in range(5)] + [f"t{i}" for i in range(4, 4 + run + 2)] + ["v"]
    hit = html_text.repeated([a, b, a], ["p", "q", "p"])
    assert hit[0].tolist() == [4, 5, 6] == hit[2].tolist() and hit[1].tolist() == [5, 6, 7]


def test_filter_equals_its_sql(spark):
    import duckdb

    from arbora.llm.queries import ORACLE

    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://S.com/en/1", ""), (2, "http://mirror.xyz/a?b=1", link.format("http://s.com/en/1")), (3, "http://alias.xyz/b#f", '<meta http-equiv="refresh" content="0; url=http://mirror.xyz/a?b=1">'),
        (4, "http://other.xyz/d/e", link.format("f")), (5, "http://other.xyz/d/f", link.format("//t.com/en/2")), (6, "http://t.com/en/2", None), (7, None, "x"), (8, "nohost/en/", ""),
        (9, "http://example.com/en/7", link.format("/home")), (10, "http://example.com/home", link.format("http://q.net/de/")), (11, "http://q.net/de/", ""),
    ]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    want = sorted(map(str, con.execute(ORACLE["op6_url_filter"]).fetchall()))
    assert sorted(str(tuple(r)) for r in url_filter.judge(pages(spark, rows)).collect()) == want
