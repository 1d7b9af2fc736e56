import itertools
import random
import re
import time

import pytest

from weftline.llm import extraction
from weftline.llm.extraction import PRIOR_WEIGHTS, Page

BODY = "These are quite a few words of a paragraph that stands in the middle of the article and says something about its matter at length."
COMMENT = "I really liked this article and would like to read more of the same kind by you soon, thanks a lot for all of it and good bye."

CASES = [
    (None, ""),
    ("", ""),
    ("plain  words\nhere", "plain words here"),
    ("<p>a &amp; b&nbsp;c</p><p>d</p>", "a & b c d"),
    ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>one<b>two</b> three<br>four<p>five</article><footer>f</footer>", "T onetwo three four five"),
    ('<article><p>Kept.</p><div class="ad">Buy</div><p>Also.</p><section id="comments"><p>Nice!</p></section></article>', "Kept. Also."),
    ("<article><p>x</p><script>var a='</p>';</script><style>p{}</style><form><input><p>mail</p></form><p>y</p></article>", "x y"),
    (f"<div class='sidebar'>side words here</div><div class='has-sidebar'><p>{BODY}</p></div><div role=navigation>go</div>", BODY),
    ("<html><head><title>t</title></head><body><main><p>Body</p><aside>a</aside></main></body>", "Body"),
    ("<article><!-- <p>no</p> --><p>yes</p><ul><li>i<li>j</ul><p>and more</p></article>", "yes i j and more"),
    ("<article>" + "<p>Er.</p>" * 40 + "</article>", " ".join(["Er."] * 40)),
    ("<article><p title='a>b'>q < r</p><", "q < r"),
    # Wrappers named after what they hold besides the article don't take it along.
    *[(f'<nav><a href=x>Menu</a></nav><div {w}><p>{BODY}</p></div><footer>f</footer>', BODY) for w in ('class="header-fixed"', 'class="layout-sidebar-left"', 'id="modal-root"', 'class="theme-banner-on"')],
    # A title in the article's own header, a label and a quotation of class share stay.
    (f"<article><header><h1>Title</h1></header><p>{BODY}</p><blockquote class=share><p>Well said here.</p></blockquote><p><label>Fig.</label> {BODY}</p></article>", f"Title {BODY} Well said here. Fig. {BODY}"),
    # Reader comments are many, the article short.
    (f"<p>{BODY}</p><div class='comments'>" + f"<p>{COMMENT}</p>" * 3 + "</div>", BODY),
    # No mark and no name: menus and adverts lose by their links and their size.
    ("<div><div><a href=a>Home</a></div><div><a href=b>News</a></div></div>" + f"<div>{BODY}</div>" * 3 + "<div>Call us now</div><div><a href=c>Terms of use</a></div>", " ".join([BODY] * 3)),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert (Page(html).main_text(PRIOR_WEIGHTS) if html else "") == text


def test_marks_are_not_read_when_scoring():
    page = f"<nav><a>m</a></nav>{{}}<h1>T</h1><p>{BODY}</p>{{}}<footer>f</footer>"
    marked, bare = page.format("<article>", "</article>"), page.format("<section>", "</section>")
    assert Page(marked).main_text(PRIOR_WEIGHTS) == Page(bare).main_text(PRIOR_WEIGHTS) == f"T {BODY}"


def test_region_equals_brute_force():
    """All ways of keeping (1), cutting (0) or leaving out items; a cut is a run of 0 between kept items."""
    rng = random.Random(1)
    for _ in range(300):
        scores = [float(rng.randrange(-4, 5)) for _ in range(rng.randrange(0, 9))]
        cost, share = rng.choice([(0.5, 0.25), (2.0, 0.125), (100.0, 0.0)])
        sums = [0.0]
        for a in range(len(scores)):
            for b in range(a + 1, len(scores) + 1):
                for inner in itertools.product([1, 0], repeat=max(b - a - 2, 0)):
                    keep = [1, *inner, 1][: b - a]
                    cuts = sum(x > y for x, y in itertools.pairwise(keep))
                    sums.append(sum(s if k else share * min(s, 0) for s, k in zip(scores[a:b], keep, strict=True)) - cost * cuts)
        parts = extraction.best_region(scores, cost, share)
        gaps = [(y, z) for (_, y), (z, _) in itertools.pairwise(parts)]
        assert all(y < z for y, z in gaps)
        total = sum(sum(scores[x:y]) for x, y in parts) + sum(share * min(s, 0) for y, z in gaps for s in scores[y:z]) - cost * len(gaps)
        assert total == max(sums) and bool(parts) == (max(sums) > 0)
        if cost == 100.0:
            assert len(parts) <= 1


# What surrounds an article without a telling class, id, role or element, and what it is.
AROUND = [
    f'<section id="responses"><h3>3 thoughts on the matter</h3><p>{COMMENT}</p><p>{COMMENT}</p></section>',
    f"<div><h4>Comments (2)</h4><div><p>{COMMENT}</p></div><div><p>{COMMENT}</p></div></div>",
    '<div class="site-end"><p>All rights reserved by the Example Publishing Company and its many partners.</p></div>',
    "<div><p>We use cookies to make this site work and to learn how it is used by all of you.</p></div>",
    '<div id="right"><h3>Most read</h3><ul><li><a href=a>One story of some words</a></li><li><a href=b>And another story</a></li></ul></div>',
    "<div><p>Subscribe to our weekly newsletter for more of this kind.</p></div>",
]
# Paragraphs of an article whose class or size could be taken for boilerplate's.
INSIDE = [
    f'<div class="social-history"><p>{BODY}</p></div>',
    f'<div class="alert-levels"><p>{BODY}</p></div>',
    "<p>By <a href=x>Ann Lee</a></p>",
    "<h2>Comments on the theory of colours and light</h2>",
    "<h2>Further reading of old maps and what they tell</h2>",
]


def plain(html):
    return " ".join(re.sub(r"<[^>]*>", " ", html).split())


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("around", AROUND)
def test_unmarked_boilerplate_goes(around, before):
    parts = [f"<h1>Title</h1><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p>", around]
    if before and "thoughts" not in around and "Comments" not in around:
        parts.reverse()
    assert Page(f"<div>{parts[0]}{parts[1]}</div>").main_text(PRIOR_WEIGHTS) == f"Title {BODY} {BODY} {BODY}"


@pytest.mark.parametrize("inside", INSIDE)
@pytest.mark.parametrize("last", [False, True])
def test_article_stays_whole(inside, last):
    page = f"<nav><a href=x>m</a></nav><div><h1>T</h1><p>{BODY}</p>{inside}{'' if last else f'<p>{BODY}</p>'}</div><footer>f</footer>"
    assert Page(page).main_text(PRIOR_WEIGHTS) == " ".join(["T", BODY, plain(inside)] + [BODY] * (not last))


def test_the_scan_decides():
    """Taking the whole page for the region, or never cutting, gives other texts; a long advert costs more than
    a short one, so that a few words behind it don't count."""
    advert = "<div class=ad>" + "buy these fine goods here " * 12 + "</div>"
    page = f"<p>{BODY}</p>{{}}<p>{{}}</p>"
    assert Page(page.format(advert, "Short end.")).main_text(PRIOR_WEIGHTS) == BODY
    assert Page(page.format("<div class=ad>buy</div>", "Short end.")).main_text(PRIOR_WEIGHTS) == f"{BODY} Short end."
    assert Page(page.format(advert, " ".join([BODY] * 5))).main_text(PRIOR_WEIGHTS) == " ".join([BODY] * 6)
    parsed = Page(f"<nav><a href=x>a b c</a></nav><p>{BODY}</p><div class=ad>buy</div><p>{BODY}</p>")
    parsed.measure()
    scores = parsed.scores(PRIOR_WEIGHTS, False)
    assert len(extraction.best_region(scores)) == 2 and len(extraction.best_region(scores, 1000.0)) == 1
    assert extraction.best_region(scores)[0][0] > 0


def test_weights_are_learned_from_marked_pages(spark):
    """x-teaser and class lead are unknown to the prior."""
    page = "<x-teaser>See our other pages for yet more of these fine words</x-teaser><article><div class=lead>{}</div><p>{}</p></article><x-teaser>{}</x-teaser>"
    rows = [(f"http://h/{i}", page.format(f"short lead {i}", BODY, COMMENT)) for i in range(20)] + [("http://h/x", None), (None, "<article>")]
    weights = extraction.learn_weights(spark.createDataFrame(rows, "url string, html string"))
    assert weights["element", "x-teaser"] < -1 < 1 < weights["word", "lead"]
    assert weights["tag", "x-teaser"] < weights["tag", "p"] < 0
    new = f"<x-teaser>{COMMENT}</x-teaser><section><div class=lead>Short one.</div><p>{BODY}</p></section><x-teaser>{COMMENT}</x-teaser>"
    assert Page(new).main_text(weights) == f"Short one. {BODY}"
    assert extraction.learn_weights(spark.createDataFrame([], "url string, html string")) == PRIOR_WEIGHTS


@pytest.mark.parametrize("html", ["<a " * 400_000, "<p title=\"" * 100_000, "<" * 1_000_000, "<div>a" * 20_000, "<div>" * 4000 + "x" + "</p>" * 40_000, "<!-- " * 200_000, "<script>" * 100_000, "x" * 2_000_000])
def test_long_and_broken_pages_take_linear_time(html):
    began = time.perf_counter()
    Page(html).main_text(PRIOR_WEIGHTS)
    assert time.perf_counter() - began < 5


def test_table(spark):
    rows = [(i, f"http://h/{i}", h, "clash") for i, (h, _) in enumerate(CASES)] + [(0, None, CASES[4][0], "clash")] * 2
    found = extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), weights=PRIOR_WEIGHTS)
    assert found.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert found.count() == len(rows)
    for r in found.collect():
        assert r["text"] == CASES[4 if r["url"] is None else r["page_id"]][1] and r["n_chars"] == len(r["text"])
    assert extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
