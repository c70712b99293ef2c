import random
import re
import time
from html import unescape

import pytest

from locusforge.llm.html_text import best_stretch, extract_text, labelled_pages, learn_scores, learned_scores, main_text, marked


def test_scan_is_the_best_contiguous_sum():
    rng = random.Random(0)
    for _ in range(300):
        values = [rng.choice([-3, -1, -0.5, 0.5, 1, 4]) for _ in range(rng.randint(1, 12))]
        found = best_stretch(list(enumerate(values)))
        best = max(sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1))
        assert (found is None) == (best <= 0)
        if found:
            assert abs(sum(values[found[0] : found[1] + 1]) - best) < 1e-9


SCORES = dict(learned_scores())


def test_scores_are_learned_and_of_the_right_sign():
    assert all(v > 0 if " " in f and f.split()[1] in ("short", "middle", "long") else v < 0 for f, v in SCORES.items())
    assert SCORES["paragraph long"] > SCORES["link middle"] and SCORES["layout"] < SCORES["text tag"]
    other = learn_scores(p.replace("<p>", "<div>").replace("</p>", "</div>") for p in labelled_pages(120, 9))
    assert other["other long"] > SCORES["other long"]  # the pages decide


@pytest.mark.parametrize("names,least", [(True, 0.95), (False, 0.9)])
def test_the_scan_finds_the_marked_articles_of_other_pages(names, least):
    pages, right = labelled_pages(400, 77), 0
    for page in pages:
        found, own = marked(page, names)
        stretch = best_stretch([(k, SCORES[f] * n) for k, (_, f, n) in enumerate(found)])
        words = lambda at: [k for k in at if SCORES[found[k][1]] > 0]
        right += stretch is not None and words(range(stretch[0], stretch[1] + 1)) == words(own)
    assert right >= least * len(pages)


def article_of(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", article)
    texts = [" ".join(unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_driver_pages_by_the_scan_alone(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert sum(main_text(p, SCORES, names=False) == article_of(p) for p in pages) >= 0.98 * len(pages)
    flat = {f: 1.0 if v > 0 else 0.0 for f, v in SCORES.items()}  # without learned weights it does not
    assert sum(main_text(p, flat, names=False) == article_of(p) for p in pages) < 0.5 * len(pages)


@pytest.mark.parametrize("page", ["<a" + " " * 1_000_000 + '"', "a <b " + "x isn't " * 120_000, '<a ="' * 200_000, "<a =' " * 200_000 + ">", "<script>" * 120_000, "<!--" * 250_000 + ">", "<" * 1_000_000, "<a" * 500_000, "<p>x" * 200_000])
def test_a_megabyte_of_litter_is_read_at_once(page):
    begun = time.process_time()
    main_text(page, SCORES)
    assert time.process_time() - begun < 3


@pytest.mark.parametrize("page,want", [
    ('<p>a b</p><svg class="icon"/><p>c d</p>', "a b\nc d"), ("<p>a b</p><noscript><p>c d</p>", "a b\nc d"), ("<p>a</p><textarea><p>b b</p>", "a\nb b"), ("<p>a</p><object><p>b b</p>", "a\nb b"),
    ('<article><h2 class="section-header">x y</h2><p class="legal">z w</p><p>ok</p></article>', "x y\nz w\nok"), ("a < b and c > d", "a < b and c > d"), ("<p>x <b isn't closed", "x <b isn't closed"),
    ("<p>a b</p><script>if (x) {<p>c d</p>", "a b\nc d"), ("<p>a b</p><!-- never closed <p>c d</p>", "a b\nc d"), ("<p>a b</p><SCRIPT type=x>var s = '<p>no</p>'</Script ><p>c d</p>", "a b\nc d"),
    ('<p title="a > b">a b</p><p title=\'</p>\'>c d</p>', "a b\nc d"), ("<p>a <![CDATA[x < y]]> b</p>", "a x < y b"),
])
def test_odd_markup_loses_no_text(page, want):
    assert main_text(page, SCORES) == want


def test_driver_pages_against_a_brute_force_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article_of(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_litter_and_odd_pages(spark):
    body = "<p>One  two&nbsp;three &lt;four&gt; &#233;.</p><p>Last<br>line<b>s</b> <a href='x>y'>here</a>.</p>"
    rows = [
        (1, None), (2, ""), (3, "<div class='ad'>buy</div>"), (4, "plain words only"), (5, "<p>open <nav>menu never closed <p>still text in here for long"),
        (6, f"<header>Site name and slogan</header><nav>a b c</nav><article><header><h1>Title</h1></header>{body}<aside>side words many of them</aside><p>After.</p>"
            "<div class='comments-section'><p>reader says a lot of things in here</p></div></article><div id=cookie-notice>we use cookies a lot</div>"
            "<form>Name <input name=q></form><script>if (a<b) {'</p>'}</script><!-- c --><footer>foot</footer>"),
        (7, "<p>" + "word " * 100_000 + "</p>"), (None, "<p>x</p>"), (8, "<h1>only a title</h1>"), (8, "<h1>only a title</h1>"),
    ]
    df = spark.createDataFrame([(i, "u", h, "t", 1) for i, h in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.text) for r in extract_text(df).collect()]
    text = dict(got)
    assert len(got) == len(rows)
    assert text[1] == text[2] == text[3] == "" and text[4] == "plain words only" and text[8] == "only a title"
    assert "still text" in text[5]
    assert text[6] == "Title\nOne two three <four> é.\nLast lines here.\nAfter."
    assert len(text[7]) == 499_999 and text[None] == "x"
    assert extract_text(df.limit(0)).count() == 0


def test_dotted_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", "x")], "`p.id` long, `u.rl` string, `h.tml` string, page_id string")
    assert [tuple(r) for r in extract_text(df, html_col="h.tml", id_col="p.id", url_col="u.rl").collect()] == [(1, "u", "a b", 3)]
