import html
import math
import random
import re

import pytest

from mixweave.llm import html_density
from mixweave.llm.html_density import extract_text, html_query, main_text

LONG = "This sentence belongs to the article and has a good number of words in it. "


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_boilerplate_goes_and_the_article_stays():
    body = (
        '<header><a href="/">Home</a><h1>Site name</h1></header><nav><ul><li><a href="/a">A menu entry</a></li></ul></nav><div class="cookie-notice">We use cookies to make this site better.</div>'
        f'<main><article><h1>Title</h1><p>{LONG}<b>Bold</b> and&nbsp;more &amp; more.</p><script>var x = "<p>no</p>";</script><div class="ad">Buy this now</div><blockquote>A quote.</blockquote><ul><li>First</li><li>Second</li></ul><p>{LONG}</p></article>'
        '<section id="comments"><h2>Comments</h2><p>A reader wrote a rather long comment here, longer than most.</p></section></main>'
        '<aside class="sidebar"><p>Something aside.</p></aside><form><label>Mail</label><input></form><footer>&copy; 2020 Somebody</footer>'
    )
    assert main_text(page(body)).split("\n") == ["Title", (LONG + "Bold and more & more.").strip(), "A quote.", "First", "Second", LONG.strip()]


def test_an_article_without_semantic_elements_is_found_by_density():
    body = (
        '<div class="x1"><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></div>'
        f'<div class="x2"><div><p>{LONG * 3}</p><p>{LONG * 2}</p></div><div><p>{LONG}</p></div></div>'
        '<div class="x3"><a href="/4">Four links</a> <a href="/5">Five links</a></div>'
    )
    assert main_text(page(body)) == "\n".join(x.strip() for x in (LONG * 3, LONG * 2, LONG))


def test_what_stands_beside_the_article():
    body = (
        f'<main><h1>Headline</h1><article><div class="post-header"><h2>Part</h2></div><p>{LONG}</p><p>{LONG}</p></article>'
        '<div><a href="/1">Read this next</a> <a href="/2">And that after it</a></div>'
        '<section><h2>3 Comments</h2><p>A reader says something of about the length of a paragraph here.</p></section></main>'
        '<div class="pageBanner">An unasked banner</div><div aria-label="Breadcrumb">Home</div><div hidden>Hidden</div><div style="display: none">Not shown</div>'
    )
    assert main_text(page(body)).split("\n") == ["Headline", "Part", LONG.strip(), LONG.strip()]


def test_a_comments_heading_cuts_only_what_it_heads():
    flat = f"<div id='content'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><h2>Comments</h2>loose<ul><li>A reader's remark.</li></ul><h3>Anna</h3><p>Her remark.</p></div>"
    assert main_text(page(flat)).split("\n") == ["Title", LONG.strip(), LONG.strip()]
    after = f"<article><div><h2>Comments</h2><p>A remark.</p><h2>Method</h2><p>{LONG}</p></div></article>"
    assert main_text(page(after)).split("\n") == ["Method", LONG.strip()]
    for title in ("Responses", "Replies"):
        section = f"<article><h1>Title</h1><p>{LONG}</p><section><h2>{title}</h2><p>{LONG}</p></section></article>"
        assert main_text(page(section)).split("\n") == ["Title", LONG.strip(), title, LONG.strip()]
    assert main_text(page(f"<article><p>{LONG}</p><section><h2>2 replies</h2><p>A remark.</p></section></article>")) == LONG.strip()


TEXT = LONG.strip()
KEPT = {
    "bare text": (f"text<div><p>{LONG}</p><p>{LONG}</p></div>tail", ["text", TEXT, TEXT, "tail"]),
    "title beside": (f"<h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div>", ["Title", TEXT, TEXT]),
    "headed section": (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><h2>Part</h2><p>short</p></div>", [TEXT, TEXT, "Part", "short"]),
    "two articles": (f"<article><h2>A</h2><p>{LONG}</p><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p></article>", ["A", TEXT, TEXT, "B", TEXT]),
    "slugs": (f'<article><h2 id="related-work">R</h2><p id="search-engines">{LONG}</p><p class="side-effects">x</p><div class="rating-scale">y</div><p>{LONG}</p></article>', ["R", TEXT, "x", "y", TEXT]),
    "market share": (f'<p>x</p><div class="market-share"><p>{LONG}</p><p>{LONG}</p></div>', ["x", TEXT, TEXT]),
    "svg": ("<article><svg/><p>after</p></article>", ["after"]),
    "svg within": (f'<article><svg viewBox="0"><path d="x"/><g><use/></g></svg><p>{LONG}</p></article>', [TEXT]),
    "links beside": (f'<div><a href="/1">One menu</a> <a href="/2">Two menu</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div><h3>More</h3><ul><li><a href="/3">Another story to read</a></li></ul></div>', [TEXT, TEXT]),
    "heading of links": (f'<div><p>{LONG}</p><p>{LONG}</p></div><h3>More</h3><ul><li><a href="/3">Another story to read</a></li></ul>', [TEXT, TEXT]),
    "small print": (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><p>&copy; 2020 Somebody</p></div>", [TEXT, TEXT]),
    "a link in a sentence": (f'Read <b>all</b> of <a href="/x">the long history of this place</a> there.<div><p>{LONG}</p><p>{LONG}</p></div>', ["Read all of the long history of this place there.", TEXT, TEXT]),
    "headings of ranks": (f"<h1>T</h1><h2>S</h2><div><p>{LONG}</p><p>{LONG}</p></div><h2>Links</h2><div><a href='/1'>here we go to more</a></div>", ["T", "S", TEXT, TEXT]),
}


@pytest.mark.parametrize("name", KEPT)
def test_what_belongs_to_the_text(name):
    body, want = KEPT[name]
    assert main_text(page(body)).split("\n") == want


def test_very_deep_pages_without_an_article():
    deep = "<div>" * 10_000 + f"<p>{LONG}</p><p>{LONG}</p>" + "</div>" * 10_000
    assert main_text(page(f"<h1>Title</h1>{deep}")) == f"Title\n{TEXT}\n{TEXT}"
    assert main_text("<ul><li>" * 3000 + LONG) == TEXT and main_text("<span>" * 5000 + "x" + "</div>" * 5000) == "x"


def random_dom(rng, depth=0):
    """(name, children) of a small DOM: strings and nodes."""
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth == 4 or rng.random() < 0.4:
            out.append(" ".join(["word"] * rng.randint(1, 30)))
        else:
            out.append((rng.choice(["div", "section", "p", "a", "b"]) if depth < 3 else rng.choice(["a", "b"]), random_dom(rng, depth + 1)))
    return out


def test_the_seed_has_the_largest_sum_of_densities():
    """Densities and their sums anew from every node's own counts."""
    rng = random.Random(5)
    for _ in range(200):
        root = html_density.parse("")
        made = []

        def build(parent, children, made=made):
            for c in children:
                if isinstance(c, str):
                    parent.children.append(c)
                else:
                    node = html_density.Node(c[0], parent)
                    parent.children.append(node)
                    made.append(node)
                    build(node, c[1], made)

        build(root, random_dom(rng))
        html_density.measure(root)

        def under(node):
            return [node, *(x for c in node.children if not isinstance(c, str) for x in under(c))]

        def chars(node, linked=False):
            return sum((len(c) if linked or not isinstance(node, html_density.Node) else 0) if isinstance(c, str) else chars(c, linked or c.name == "a") for c in node.children)

        def density(node):
            c, t = chars(node, True), len(under(node))
            lc, lt = chars(node, node.name == "a"), sum(x.name == "a" for x in under(node))
            whole = chars(root, False) / max(chars(root, True), 1)
            base = math.log(c * max(lc, 1) / max(c - lc, 1) + whole * c + math.e)
            return c / t * math.log(max(c * t / (max(lc, 1) * max(lt, 1)), 1)) / math.log(base) if c and base > 1 else 0

        sums = {id(n): sum(len(c) if isinstance(c, str) else density(c) for c in n.children) for n in [root, *made]}
        assert all(abs(n.density - density(n)) < 1e-9 for n in made if not any(p.name == "a" for p in ancestors(n)))
        if not any(n.name == "a" and any(x.name == "a" for x in under(n)[1:]) for n in made):
            assert sums[id(root.top)] == pytest.approx(max(sums.values()))


def ancestors(node):
    while (node := node.parent) is not None:
        yield node


SLUGS = ['<section id="discussion">', '<section id="advertising-history">', '<section aria-label="Search for missing ships">', '<div class="side-effects">', '<section class="discussion">', '<section class="navajo-history">']


@pytest.mark.parametrize("tag", SLUGS)
def test_ordinary_slugs_stay_in_the_article(tag):
    end = f"</{tag[1:].split()[0]}>"
    inner = f'<h1>Title</h1><p>{LONG}</p>{tag}<h2 id="related-work">Related work</h2><p>{LONG * 2}</p>{end}<h2 id="side-effects">Side effects</h2><p>{LONG}</p>'
    want = ["Title", LONG.strip(), "Related work", (LONG * 2).strip(), "Side effects", LONG.strip()]
    assert main_text(page(f"<article>{inner}</article>")).split("\n") == want
    assert main_text(page(f"<div>{inner}</div>")).split("\n") == want


def test_boilerplate_in_the_article_still_goes():
    for box in ('<div class="share-buttons">Share this</div>', '<div class="related-posts"><a href="/1">A long teaser of another article</a></div>', '<div id="related"><a href="/1">Another one</a></div>', '<div class="newsletter-box"><p>Get our letter.</p></div>', '<div class="ad-slot">Buy</div>', f'<div id="disqus_thread">{LONG}</div>', f'<div id="comments">{LONG}</div>'):
        assert main_text(page(f"<article><p>{LONG}</p>{box}<p>{LONG}</p></article>")).split("\n") == [LONG.strip()] * 2


def test_markup_as_browsers_read_it():
    assert main_text("<article><p>a<p>b<br>c<i>d</i>e<p>&eacute;&#233;&#xe9; &lt;p&gt;</article></div>") == "a\nb cde\néé\u00e9 <p>"
    assert main_text("<article><h1>x</h1><p><b>bold<p>on</b> end</p></article>") == "x\nbold\non end"
    assert main_text("<article><!-- <p>no</p> --><p title='a > b'>yes</p><style>p{}</style></article>") == "yes"
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("<article><p>cut off <b") in ("cut off <b", "cut off")


@pytest.mark.parametrize("empty", [None, "", " ", "<html></html>", "<script>x</script>", "<nav>a</nav>"])
def test_nothing_gives_an_empty_text(empty):
    assert main_text(empty) == ""


def test_very_deep_and_long_pages():
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>") == "deep"
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").split("\n")) == 5000


def test_all_pages_equal_their_articles(spark, sf_dir):
    """The test pages have one article each; a plain reading of it is the brute-force version."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r["page_id"]: r for r in html_query(pages).collect()}
    rows = pages.collect()
    assert len(texts) == len(rows)
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert texts[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert texts[r["page_id"]]["n_chars"] == len(texts[r["page_id"]]["text"])


def test_rows_and_columns(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    out = html_query(pages).collect()
    assert sorted(r["text"] for r in out) == ["", "a", "a"]
    assert extract_text(pages.limit(0)).count() == 0
