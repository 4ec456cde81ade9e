"""Near-duplicate operators against brute force, and connected components."""

import random
import re

import pytest

from ledgerloom.llm import graph, minhash, pages


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if rows[i][0] == rows[j][0] or x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_equals_brute_force(spark, percent):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "x y", "ÀB", "Zz"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A B\tC\x0bD"), (7, "a b c d e"), (8, "one two")]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200, 900]))]
        for _ in range(rng.choice([1, 2, 9, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 * family + 1000 - len(rows), " ".join(copy)))
    rows += [(5000, "y" * 200_000), (5001, " ".join(["z"] * 30_000)), (rows[20][0], "same id with another text of its own")]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n long, rep long")
    got = sorted(map(tuple, minhash.near_duplicates(frame, percent=percent).collect()))
    assert got == brute(rows, percent)


def test_minhash_without_rows_and_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(minhash.near_duplicates(null).collect(), key=str) == sorted([(None, 2, None, True)] * 2 + [(1, 2, 1, True)], key=str)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=70).collect()))
    assert got == brute(rows, 70)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 199), (200, 199)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {199: 199, 200: 199}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<html><head><title>t</title><script>var x="<p>no</p>"</script></head><body class="page header-fixed"><header><a href=/>Home</a> Site</header>
<nav><p>menu, menu, menu, menu, menu, menu, menu</p></nav><div id=content><div class="cookie-notice"><p>We use cookies, lots of cookies, so accept them please, thanks.</p></div>
<div class=post><h2>Title &amp; more</h2><p>First para, with commas, and   text &lt;ok&gt; that is long enough.<p>Second &eacute;&nbsp;para<br>line two, with <a href=x>link</a>.</p>
<ul><li>one<li>two</ul></div><div class="comments"><p>Nice article, really, I like it a lot, so much, so good, so fine</p></div></div>
<aside><p>side, bar, text, long, long, long, long</p></aside><form><p>Subscribe, now, or never, or later, please</p></form><!-- <p>x</p> --><footer>(c)</footer></body></html>"""


def test_page_text():
    assert pages.main_text(PAGE) == "Title & more\n\nFirst para, with commas, and text <ok> that is long enough.\n\nSecond é para line two, with link.\n\none\n\ntwo"
    assert pages.main_text("<article><h1>T</h1><p>Short.</article><div class=ad>Buy, buy, buy, this, very, long, advert, now, please, do</div>") == "T\n\nShort."
    assert [pages.main_text(x) for x in (None, "", "<", "<p>cut <b", "a < b &amp; c", "<script>x", "<!-- x", "<p></p>")] == ["", "", "<", "cut", "a < b & c", "", "", ""]
    assert len(pages.main_text("<p>" * 3000 + "word, " * 5000)) > 20_000
    assert pages.main_text("<div>" * 2000 + "<p>deep, deep text, and more of it, to be sure</p>") == "deep, deep text, and more of it, to be sure"


def test_pages_frame(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = pages.extract(frame).collect()
    assert sorted(r.n_chars for r in got) == [0, len(pages.main_text(PAGE)), len(pages.main_text(PAGE))]
    assert pages.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "wrapper",
    ['div class="content no-sidebar"', 'div class="post has-sidebar"', 'div class="story ad-free"', 'div class="entry comment-open"', 'div class="post share-enabled"', 'div class="article related-posts-off"', 'article class="post no-sidebar"', 'div class="content"',
     'div class="article commentary"', 'div class="banner"', 'section id="popular"', 'main class="menu"'],
)
def test_articles_keep_their_text_whatever_their_layout_is_called(wrapper):
    text = "A long enough paragraph, with some commas, that any reader would take for the article."
    page = f"<body><nav><p>menu, menu, menu, menu, menu, menu, menu</p></nav><{wrapper}><p>{text}</p><p>{text}</p></{wrapper.split()[0]}></body>"
    assert pages.main_text(page) == f"{text}\n\n{text}"


def test_what_surrounds_an_article_goes():
    text = "A long enough paragraph, with some commas, that any reader would take for the article."
    other = "Other words, many of them, with commas, and even more, so that they score well, very well, indeed."
    for around in ('div class="comments"', 'div class="entry comment"', 'div class="sidebar"', 'div class="sidebar-left"', 'article class="related"', 'div class="ad-slot"', 'div id="cookie-notice"', 'div class="newsletter open"', 'div hidden', 'aside', 'form class="content"'):
        page = f"<body><div class=post><p>{text}</p><p>{text}</p></div><{around}><p>{other}</p></{around.split()[0]}></body>"
        assert pages.main_text(page) == f"{text}\n\n{text}", around
    assert pages.main_text(f"<div class=comments><p>{other}</p></div>") == ""


def test_deep_and_broken_pages_take_linear_time():
    import time

    paragraph = "<p>Words, of a paragraph, long enough to count.</p>"
    began = time.time()
    assert pages.main_text(("<div>" + paragraph) * 50_000).count("Words") >= 1
    assert time.time() - began < 4
    for page in ("<div>" * 50_000 + paragraph, "<b>" * 50_000 + paragraph * 100, "<div>" * 20_000 + "</p></b>" * 20_000 + paragraph, "<li>" * 50_000, "<header>" * 20_000):
        began = time.time()
        pages.main_text(page)
        assert time.time() - began < 2, page[:20]
