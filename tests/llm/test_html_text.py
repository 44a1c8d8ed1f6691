import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li>About</ul></nav><div class="top-ad box">Buy</div>
<article><header><h1>A  title &amp; more</h1></header><p><b>One<br>two&nbsp;three <p>Four&eacute; &lt;b&gt; &am <i>five</i>.</p><!-- no -->
<div class="share">Tweet</div><ul><li>item 1<li>item 2</ul><form>Name <input></form><aside>see also</aside><p hidden>x</p></article>
<section id="comments"><p>First!</p></section><footer>&copy; us</footer></body></html>"""


def test_blocks():
    main = [t for k, t in H.blocks_of(PAGE) if k == H.MAIN]
    assert main == ["A title & more", "One two three", "Fouré <b> &am five.", "item 1", "item 2"]
    assert not [t for k, t in H.blocks_of(PAGE) if k == H.OPEN]
    assert [t for _, t in H.blocks_of("a < b <p>c</p d")] == ["a < b", "c"]
    for odd in (None, "", " ", "<", "<p", "<!--", "<script>", "<a href='x", "</p></p>", "<p>" * 3000, "x" * 300_000, "<div class=>y"):
        H.blocks_of(odd)
    rng = random.Random(1)
    for _ in range(500):  # whatever comes
        H.blocks_of("".join(rng.choice(["<p>", "</p>", "<", ">", "a ", "&amp;", "<nav>", "</nav>", "'", '"', "<article ", "<!--", "-->", "<br/>"]) for _ in range(30)))


def test_blocks_of_an_article_stay():
    page = """<article><div class="article-header"><h1 id="main-banner">A head</h1></div><p class="legal">B legal</p><p class="notice">C</p>
    <math><mi>x</mi></math><div class="post-content menu"><p class="comment-like header">D <span class="nav-label">own</span></p></div><h2 class="copyright">E</h2>
    <div class="post-comments">no</div><div class="notice">no</div><ul class="share">no</ul><p class="ad">no</p><div class="ad-box">no</div><nav>no</nav>
    <section id="related-posts">no</section><div class="entry-alert">F</div></article><div class="menu">no</div>"""
    assert [t for k, t in H.blocks_of(page) if k == H.MAIN] == ["A head", "B legal", "C", "x", "D own", "E", "F"]


def test_menus_and_notices_in_an_article_go():
    for box in ('<div class="menu">', '<div class="footer">', '<div class="banner">', '<ul class="navigation">', '<section class="discussion">', '<div class="related-posts-2">', '<div class="comments-area">', '<div class="wp-ad-unit">', '<div id="social">', '<div class="copyright">'):
        tag = box[1:].split()[0]
        assert [t for k, t in H.blocks_of(f"<article><p>before</p>{box}<p>no</p></{tag}><p>after</p></article>") if k == H.MAIN] == ["before", "after"], box
    for box in ('<div class="social-policy">', '<div class="related-work">', '<section class="share-prices">', '<div class="entry-footer">', '<div class="comment-on-the-text">'):
        tag = box[1:].split()[0]
        assert [t for k, t in H.blocks_of(f"<article><p>before</p>{box}<p>kept</p></{tag}><p>after</p></article>") if k == H.MAIN] == ["before", "kept", "after"], box


def test_pieces_keep_their_kind():
    main = lambda page: [t for k, t in H.blocks_of(f"<article>{page}</article>") if k == H.MAIN]
    assert main("<p>Good text <button>x</p><p>more</p>") == ["Good text", "more"]
    assert main('<p>Good <a class="share">share it</p>') == ["Good"]
    assert main('<div>Own text <label class="signup">sign up</div><p>next</p>') == ["Own text", "next"]
    assert main("<p>One <button>Buy</button> two <b>three</b></p>") == ["One two three"]
    assert main('<p>A&amp;B <span class="share">x &lt;</span>C<br>D</p>') == ["A&B C D"]
    assert [t for k, t in H.blocks_of("<article><p>One <button>Buy</button> two</p></article>") if k == H.BOILERPLATE] == ["Buy"]


def test_deep_and_unclosed_markup_takes_linear_time():
    import time

    took = []
    for n in (4_000, 32_000):
        at = time.process_time()
        for page in ("<span>" * n + "</b>" * n, "<i>" * n + "<div></div>" * n, "<div><b>" * n + "</i>x" * n, "<p><span>" * n):
            H.blocks_of(page)
        took.append(time.process_time() - at)
    assert took[1] < 30 * took[0]


def brute_covered(streams, run, pages):
    seen = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            seen.setdefault(tuple(s[i : i + run]), set()).add(k)
    out = []
    for s in streams:
        m = np.zeros(len(s), bool)
        for i in range(len(s) - run + 1):
            if len(seen[tuple(s[i : i + run])]) >= pages:
                m[i : i + run] = True
        out.append(m)
    return out


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(1)
    for run, pages in [(1, 2), (2, 2), (4, 3), (8, 3)]:
        for _ in range(20):
            streams = [rng.integers(0, 3, rng.integers(0, 40)) for _ in range(8)]
            for a, b in zip(H.covered(streams, run, pages), brute_covered(streams, run, pages), strict=True):
                assert a.tolist() == b.tolist()


def test_open_pages_lose_repeated_runs_and_keep_unique_ones(spark):
    menu = "home news sport weather politics business science health travel"
    own = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6)]
    rows = [(i, "http://H.example/%d" % i, f"<div>{menu} {own[i]}</div><p>short {i}</p>") for i in range(6)]
    rows += [(10 + i, f"http://copies.example/{i}", f"<div>{own[0]}</div>") for i in range(4)]  # copies stay whole
    rows += [(20 + i, "http://h.example/a", f"<nav>{menu}</nav><article><p>{menu} {own[i]}</p></article>") for i in range(3)]
    rows += [(30, None, None), (31, "x", ""), (31, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "host", "text", "words", "kinds")})
    for shard_words in (1_000_000, 150):
        got = sorted((r.page_id, r.text, r.n_chars) for r in H.main_texts(pages, shard_words=shard_words).collect())
        want = [(10 + i, own[0]) for i in range(4)] + [(20 + i, f"{menu} {own[i]}") for i in range(3)] + [(30, ""), (31, ""), (31, "")]
        want += [(i, f"{own[i]}\n\nshort {i}") for i in range(6)]  # the same for a host that takes many tasks
        assert got == sorted((i, t, len(t)) for i, t in want)


def test_large_hosts_lose_the_runs_that_small_ones_lose(spark):
    rng = random.Random(8)
    common = [" ".join(f"c{k}x{i}" for i in range(rng.choice([7, 8, 9, 20]))) for k in range(40)]
    pieces = {i: [f"p{i} {k} " + " ".join(f"u{i}x{k}x{j}" for j in range(6)) for k in range(8)] for i in range(60)}
    for k, run in enumerate(common):  # a run on 1 to 10 pages of a host that would take many tasks
        for i in rng.sample(range(60), 1 + k % 10):
            pieces[i].insert(rng.randrange(len(pieces[i])), f"{run} {run}" if k % 4 == 0 else run)
    kinds = ["<div>%s</div>", "<nav>%s</nav><p>own words</p>", "<article>text</article><footer>%s</footer>"]
    rows = [(i, "http://one.example/%d" % i, kinds[0 if i % 5 else rng.randrange(3)] % " ".join(p)) for i, p in pieces.items()]
    rows += [(100 + i, "http://two.example/", "<p>a b c</p>") for i in range(5)] + [(200 + i, "http://three.example/", f"<nav>{common[0]}</nav><main>m</main>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, spread = (sorted((r.page_id, r.text) for r in H.main_texts(pages, shard_words=n).collect()) for n in (1_000_000, 150))
    assert spread == whole == sorted((r.page_id, r.text) for r in H.main_texts(pages.repartition(7), shard_words=150).collect())
    for k, run in enumerate(common):
        left = sum(f" {run}" in t for _, t in whole)
        assert left == 0 or len(run.split()) < H.RUN or sum(run in h for i, _, h in rows if i < 100) < H.PAGES, (k, left)


def test_pages_table(spark):
    """Against a second reading of these pages' plain structure."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in H.main_texts(pages).collect()}
    assert got.keys() == source.keys()
    for i, h in source.items():
        article = re.search(r"<article>(.*?)(</article>|\Z)", h, re.S)
        parts = re.split(r"</?(?:p|h1|div)>", re.sub(r"<(/?b|br)>", lambda m: " " if m[1] == "br" else "", article[1])) if article else []
        assert got[i] == "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)
    assert H.main_texts(pages.limit(0)).count() == 0
