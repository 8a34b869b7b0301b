import html
import re

import pytest

from waymark.llm import html_tree
from waymark.llm.shared import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><a href=/>Home</a></header><nav><ul><li>One<li>Two</ul></nav>
<div class="cookie-notice">We use cookies</div>
<div class="wrap"><p>Read {n} this first</p></div>
<article><header><h1>Title&nbsp;{n}</h1></header><p>Body <b>bold</b>
 text &amp; more {n}<br><p>second<table><tr><td>cell {n}<td>next</table>
<aside>see also</aside><script>var a="<p>no</p>"</script></article>
<div class="box"><p>Always the same words</p></div>
<section id="comments"><p>a reader {n}</p></section><form><input><p>mail</p></form>
<footer>&copy; site</footer></body></html>"""


# Their content is text for the parser, to the end tag or the end of the page.
RAW = {"script", "style", "textarea", "title", "iframe"}


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in html_tree.extract(pages).collect()}


def test_branches_are_cut_by_role_and_repetition(spark):
    rows = [(n, f"https://a.example/{n}", PAGE.format(n=f"n{n}")) for n in range(12)]
    got = extracted(spark, rows)
    for n in range(12):
        assert got[n].text.split("\n") == [
            f"Read n{n} this first",
            f"Title n{n}",
            f"Body bold text & more n{n}",
            "second",
            f"cell n{n}",
            "next",
        ]
        assert got[n].n_chars == len(got[n].text)


def test_few_pages_are_judged_by_role_alone(spark):
    got = extracted(spark, [(1, "http://b.example/x", PAGE.format(n=1))])
    assert "Always the same words" in got[1].text and "cookies" not in got[1].text


def test_given_pages_give_their_articles(spark, small):
    pages = table(spark, small, "pages")
    got = {r.page_id: r.text for r in html_tree.extract(pages).collect()}
    for row in pages.collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", row.html)[1]
        blocks = (re.sub("<[^>]+>", "", part) for part in re.split(r"</?(?:p|h1)>", inside))
        wanted = "\n".join(b for part in blocks if (b := " ".join(html.unescape(part).split())))
        assert got[row.page_id] == wanted


def test_odd_pages(spark):
    rows = [
        (1, None, None),
        (2, "not a url", ""),
        (3, "http://c.example", "<p>open <b>tags &amp &lt; <li>item</p></b></div></article> tail"),
        (3, "http://c.example", "<p>twice"),
        (None, "http://c.example", "no tags at all \t\n x"),
        (4, "http://c.example", "<div " * 50 + "<p>" * 500 + "deep" + "<ul><li>" * 200 + "x" * 100_000),
        (5, "http://c.example", "<article></article>"),
        (6, "http://c.example", "<script>unclosed <p>no"),
    ]
    schema = "page_id long, url string, html string, text int, blocks string, host string, path string, cut int"
    pages = spark.createDataFrame([(*row, 1, "b", "h", "p", 2) for row in rows], schema)
    got = [(r.page_id, r.text) for r in html_tree.extract(pages).collect()]
    assert len(got) == len(rows)
    by_id = dict(got)
    assert by_id[1] == by_id[2] == by_id[5] == by_id[6] == "" and by_id[None] == "no tags at all x"
    assert by_id[4].endswith("x" * 100_000)
    assert html_tree.extract(pages.limit(0)).count() == 0


def test_a_head_left_open_ends_where_the_body_starts():
    head = "<html><head><title>x</title><meta charset=utf-8><style>p{}</style>"
    for page in (
        f"{head}<body><p>Text",
        f"{head}<p>Text",
        f"{head}<b>Text</b>",
        f"{head}\n Text",
        f"{head}<noscript><link><body><p>Text",
        f"{head}</head><body><p>Text",
        f"{head}<script>var p = '<p>no'</script><noscript><p>no</noscript><body><p>Text",
        "<body><head><title>x</title><p>Text",
    ):
        assert [text for _, text in html_tree.parse(page)[0]] == ["Text"], page


def texts(page):
    return [text for _, text in html_tree.parse(page)[0]]


@pytest.mark.parametrize("tag", sorted(html_tree.SKIP - {"head"}))
def test_skipped_elements_in_every_form(tag):
    """Closed, closed by a slash, and left open: nothing but their own text goes."""
    assert texts(f"<p>One</p><{tag}>no</{tag}><p>Two</p>") == ["One", "Two"]
    assert texts(f"<p>One</p><{tag} id='x'/><p>Two</p>") == ["One", "Two"]
    assert texts(f"<div><p>One <{tag}/> more</p><{tag}/></div><p>Two") == ["One more", "Two"]
    if tag not in RAW:
        assert texts(f"<div><p>One</p><div><{tag}>no</div><p>Two</p></div>") == ["One", "Two"]
        if tag not in html_tree.FOREIGN:  # those a block of the page ends, as in browsers
            assert texts(f"<div><{tag}><div>no</div><b>no</b></{tag}><p>Two</p></div>") == ["Two"]


@pytest.mark.parametrize(
    "page",
    [
        "<svg><svg/></svg><p>Two",
        "<svg><path d=1/><g><circle/></g></svg><p>Two",
        "<svg width=1><path><p>Two</p>",
        "<math><mi>x</mi><p>Two</p>",
        "<svg><foreignObject><div>no</div></foreignObject></svg><p>Two",
        "<button>no<p>Two</p>",
        "<button><div>no</div></button><p>Two</p>",
        "<option>no<p>Two</p>",
        "<select><option>no<option>no</select><p>Two</p>",
        "<noscript><p>no</p><div>no</div></noscript><p>Two</p>",
        "<video><source src=x><p>no</p></video><p>Two</p>",
    ],
)
def test_elements_within_skipped_ones(page):
    assert texts(f"<p>One</p>{page}") == ["One", "Two"]


def test_an_icon_above_the_article(spark):
    got = extracted(spark, [(1, "http://icon.example/1", "<body><div><svg width='1'/><article><p>Text</p></article></div>")])
    assert got[1].text == "Text"


def test_a_page_without_head_end_keeps_its_text(spark):
    got = extracted(spark, [(1, "http://d.example/1", "<html><head><title>x</title><body><p>Text")])
    assert got[1].text == "Text"


def test_a_word_in_the_class_of_a_wrapper_cuts_nothing(spark):
    aside = "<div class='left-sidebar'><p>side</p></div><div id=site-footer>foot</div><div class='cookie-notice'>We use</div>"
    wraps = [
        "<div class='layout has-sidebar'>{}</div>",
        "<div class='content no-sidebar'><div>{}</div></div>",
        "<article id='post-search-engines'>{}</article>",
        "<article class='search'>{}</article>",
        "<div class='sidebar'><article>{}</article></div>",
        "<div id=search><div class=banner>{}</div></div>",
        "<form id=aspnetForm><main>{}</main></form>",
        "<form>{}</form>",
        "<div id=part-side-by-side>{}</div>",
    ]
    body = "<p>The words of page {} are not those of any other page</p>"
    rows, wanted = [], {}
    for n, wrap in enumerate(wraps):
        for page in range(5):  # on hosts of one page and of five
            for host in ("one", "five") if page == 0 else ("five",):
                at = len(rows)
                rows.append((at, f"http://{host}{n}.example/{page}", f"<body>{wrap.format(body.format(at))}{aside}"))
                wanted[at] = f"The words of page {at} are not those of any other page"
    got = extracted(spark, rows)
    assert {at: got[at].text for at in wanted} == wanted


def test_comments_longer_than_the_article_are_cut(spark):
    page = "<article><p>short</p></article><ol class='comment-list'>" + "<li><article class='comment'>a long reply</article>" * 9
    assert extracted(spark, [(1, "http://e.example/1", page)])[1].text == "short"


def test_copies_of_a_page_keep_their_article(spark):
    def page(n, advert):
        return f"<div class=ad>advert {advert}</div><div class=box>Always the same</div><article><h1>T{n}</h1><p>Body {n}</article>"

    rows = [(n, "http://copies.example/x", page(0, 0)) for n in range(5)]
    rows += [(10 + n, "http://crawled.example/x", page(0, n)) for n in range(5)]
    rows += [(100 + n, f"http://mirror.example/{n}", page(max(0, n - 56), 0)) for n in range(60)]
    got = extracted(spark, rows)
    assert {got[n].text for n in (*range(5), *range(10, 15))} == {"Always the same\nT0\nBody 0"}  # one page says nothing
    for n in range(60):
        assert got[100 + n].text == f"T{max(0, n - 56)}\nBody {max(0, n - 56)}"
