import random
import time

import pytest
from conftest import SF_MID

from termlink.llm import html_text, queries

STOPPY = "the cat of the house is in the garden and it is on the wall with a bird " * 4
RARE = "zinc copper nickel cobalt chrome titan iron lead tungsten silver gold " * 5


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("just text", "just text"),
    ("<p>one</p><p>two &amp; three&#33;</p>", "one\ntwo & three!"),
    ("<article><h1>T</h1><p>a  \n b\t<b>c</b>d<br>e</p><p>f</article>", "T\na b cd e\nf"),
    ("<nav><ul><li><a href=x>m</a><article><p>kept</p></article>", "kept"),
    ("<article><p>one<div class='ad'>buy</div><p>two<aside>no</aside><p>three</article>", "one\ntwo\nthree"),
    ("<article><header><h1>Title</h1></header><p>Body</p><footer>x</footer><section id=comments><article><p>c</p></article></section></article>",
     "Title\nBody"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><article><p>yes</p><form><p>name</p><input></form></article>", "yes"),
    ("<article><p>a &lt;b&gt; &nbsp;&eacute; &copy; &#x41; &unknown; c</p></article>", "a <b> é © A &unknown; c"),
    ("<!-- <p>no</p> --><article><p title='a > b'>yes</p><p hidden>no</p></article>", "yes"),
    ("<header><p>site</p></header><article><p>x</p></article><footer><p>f</p></footer>", "x"),
    ("<div class='loading shadow'><article><p>x</p></article></div>", "x"),
    ("<article><p>text</p><textarea>no</textarea><p>unclosed <b>bold", "text\nunclosed bold"),
    ("<article><ul><li>first</li><li>second</li></ul></article>", "first\nsecond"),
    ("<article><p><a href=x>only a link in a paragraph</a></p><p>real <a href=y>l</a> words here</p></article>", "real l words here"),
    # without an article: density of stop words, length and links decide
    (f"<div>{STOPPY}</div><div>{RARE}</div>", " ".join(STOPPY.split())),
    (f"<div><a href=x>{STOPPY}</a></div><div>{STOPPY}</div>", " ".join(STOPPY.split())),
    # short blocks take the label of their decided neighbours
    (f"<p>{STOPPY}</p><p>short one</p><p>{STOPPY}</p><p>last</p>", "\n".join([" ".join(STOPPY.split()), "short one", " ".join(STOPPY.split())])),
    (f"<h2>Head</h2><p>{STOPPY}</p>", "Head\n" + " ".join(STOPPY.split())),
    (f"<p>{RARE}</p><p>short</p><p>{RARE}</p><p>{STOPPY}</p>", " ".join(STOPPY.split())),
])
def test_rules(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-comments", "elementor-widget elementor-widget-text-editor",
                                  "search-result", "widget"])
def test_a_name_is_a_prior(name):
    long = " ".join(STOPPY.split())
    # an article inside a named container is one; long text without an article is judged by its density
    assert html_text.main_text(f"<div class='{name}'><article><h1>Head</h1><p>{RARE}</p><p>end</p></article></div>") == \
        f"Head\n{' '.join(RARE.split())}\nend"
    assert html_text.main_text(f"<article><div class='{name}'><p>{STOPPY}</p></div></article>") == long
    assert html_text.main_text(f"<div id='{name}'><p>{STOPPY}</p></div>") == long


def test_what_a_bad_name_still_drops():
    page = (f"<article><p>{STOPPY}</p><div class='ad'>Buy it now</div><div class='related-posts'><a href=x>{STOPPY}</a></div>"
            f"<div id=newsletter><p>{RARE}</p></div></article><div role=search>{STOPPY}</div><aside>{STOPPY}</aside>")
    assert html_text.main_text(page) == LONG


LONG = " ".join(STOPPY.split())
SHORT = "<p>Short paragraph</p>"


@pytest.mark.parametrize("page, want", [
    # reader comments, whatever their length, element and place
    (f"<main><p>{LONG}</p></main><div id='comments'><article class='comment'><p>{LONG}</p></article></div>", LONG),
    (f"<main><p>{LONG}</p><div id='comments'><article class='comment'>Two words</article></div></main>", LONG),
    (f"<article><p>{LONG}</p><section class='comment-list'><article><p>{LONG}</p></article></section></article>", LONG),
    (f"<article><p>{LONG}</p><article class='user-comment'><p>{LONG}</p></article></article>", LONG),
    (f"<article><p>{LONG}</p></article><div class='comments'><p>long {LONG}</p></div>", LONG),
    (f"<div class='comments'><p>{LONG}</p></div>", ""),
    # related pages, adverts and notices
    (f"<main><p>{LONG}</p><div class='related'><article><h3>T</h3><p>Short teaser</p></article></div></main>", LONG),
    (f"<article><p>{LONG}</p></article><div class='recommended-posts'><article><h3>T</h3><p>{LONG}</p></article></div>", LONG),
    (f"<div class='cookie-notice'><p>{LONG}</p></div><article>{SHORT}</article>", "Short paragraph"),
    (f"<article><p>{LONG}</p><div class='ad-slot'>{LONG}</div></article>", LONG),
    (f"<article><p>{LONG}</p></article><aside><article><p>{LONG}</p></article></aside>", LONG),
    (f"<article><p>{LONG}</p></article><div class='sidebar'><article><p>{LONG}</p></article></div>", LONG),
    # menus and notices without a name
    (f"<main><div>Home Shop Contact</div><h1>T</h1><p>{LONG}</p><p>The end.</p><p>Sign up for our letter today</p></main>", f"T\n{LONG}\nThe end."),
    (f"<main><ul><li>Home</li><li>Shop</li></ul><p>{LONG}</p><div>Print Share</div></main>", LONG),
    (f"<article><ul><li>Home</li><li>Shop</li></ul><p>{LONG}</p><div>Print Share</div></article>", LONG),
    # what belongs to an article
    (f"<article><p>{LONG}</p><div class='widget'>{SHORT}</div><p>{LONG}</p></article>", f"{LONG}\nShort paragraph\n{LONG}"),
    (f"<article><div class='sidebar-layout'>{SHORT}<p>{LONG}</p>{SHORT}</div></article>", f"Short paragraph\n{LONG}\nShort paragraph"),
    (f"<article>{SHORT}<p>{LONG}</p><div class='ad'>x</div>{SHORT}<aside>x</aside>{SHORT}<ul><li>one</li><li>two</li></ul></article>",
     f"Short paragraph\n{LONG}\nShort paragraph\nShort paragraph\none\ntwo"),
    (f"<article><p>{LONG}</p><p>See <a href=x>the rest of the house</a></p><ul><li><a href=x>mostly a link</a> to it</li></ul></article>",
     f"{LONG}\nSee the rest of the house\nmostly a link to it"),
    (f"<article><p>{LONG}</p><p>{RARE}</p><p>end</p></article>", f"{LONG}\n{' '.join(RARE.split())}\nend"),
    (f"<div class='content no-comments'><p>{LONG}</p></div>", LONG),
    # left open around the article
    (f"<aside><p>x</p><article><p>{LONG}</p></article>", LONG),
])
def test_what_is_the_article(page, want):
    assert html_text.main_text(page) == want


def plain_neighbours(labels, i, step):
    i, near = i + step, False
    while 0 <= i < len(labels):
        if labels[i] in ("good", "bad"):
            return labels[i], near
        near = near or labels[i] == "near"
        i += step
    return "bad", near


def test_second_pass_equals_a_walk_to_the_neighbours():
    r = random.Random(3)
    for _ in range(300):
        first = [r.choice(["good", "bad", "near", "short", "out"]) for _ in range(r.randrange(1, 12))]
        found = [html_text.Block("x", 0, "", x == "out", 0, False, 0, False) for x in first]
        got = html_text._second_pass(found, first, 200)
        for i, one in enumerate(first):
            (before, near_before), (after, near_after) = plain_neighbours(first, i, -1), plain_neighbours(first, i, 1)
            if one == "near":
                want = "good" if "good" in (before, after) else "bad"
            elif one == "short":
                want = before if before == after else "good" if (near_before if before == "bad" else near_after) else "bad"
            else:
                want = one
            assert got[i] == want


@pytest.mark.parametrize("page", [
    "<table>" + "<tr><td>ab</td></tr>" * 100_000 + "</table>", "<h2>a</h2>" * 100_000, "<article>" + "<li>a<p>b" * 50_000,
    "<div class='widget'>" * 50_000 + "a", "<article><p>" + "<p>x</p>" * 100_000, "<aside><article>" * 30_000 + "</aside>" * 30_000])
def test_time_grows_with_the_page(page):
    def seconds(text):
        began = time.process_time()
        html_text.main_text(text)
        return time.process_time() - began
    part = min(seconds(page[: len(page) // 8]) for _ in range(2))
    assert seconds(page) < 8 * 3 * part + 0.5


def brute_article(page):
    """What stands in the article element of the given pages, by plain string work."""
    import html as H
    import re
    body = page.split("<article>")[1].split("</article>")[0]
    out = []
    for part in re.split(r"</?(?:p|h1)>", body):
        text = " ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", part))).replace("\xa0", " ").split())
        if text:
            out.append(text)
    return "\n".join(out)


def test_given_pages(spark):
    rows = queries.op8_html_extraction(spark, SF_MID).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute_article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, "u", "clash"), (2, "", None, "c"), (None, "<article><p>x</p></article>", "u", "c"),
            (4, "<article>" + "<p>many words</p>" * 20_000 + "</article>", "u", "c"), (5, "<p" * 2000, "u", "c"),
            (5, "<<>><p a='", "u", "c"), (6, "<div>" * 5000 + "deep", "u", "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string").repartition(3)
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    by = {r.page_id: r.text for r in got.collect()}
    assert by[1] == by[2] == "" and by[None] == "x" and by[6] == "deep"
    assert by[4] == "\n".join(["many words"] * 20_000)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_given_pages_without_their_article_tags():
    """The density path alone: what it loses are short closing lines and paragraphs with few stop words (12.9 % of the characters)."""
    import pyarrow.parquet as pq
    lost = total = 0
    for page in pq.read_table(f"{SF_MID}/pages.parquet")["html"].to_pylist():
        want = html_text.main_text(page).split("\n")
        got = html_text.main_text(page.replace("<article>", "").replace("</article>", "")).split("\n")
        assert set(got) <= set(want)
        total += sum(map(len, want))
        lost += sum(map(len, want)) - sum(map(len, got))
    assert lost < 0.15 * total
