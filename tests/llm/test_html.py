import os
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tickloom.llm import html as H

ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p><article>no</article>";</script></head><body>
<header class="site"><h2>Site</h2></header><nav><ul><li><a href="/x>y">menu</a><li>more</ul></nav><!-- <article>no</article> -->
<div class="ad">buy</div><div id="cookie-notice">notice</div>
<article><header><h1>Head&nbsp;line &lt;1&gt;</h1></header><p><b>First   par&shy;t.<br><p>Second
 <i>in</i>line &copy 2 <span class="ad">spam</span>end</p><table><tr><td>cell<td>two</table><form><p>mail?</p></form>
<section class="comments"><article class="comment"><p>reader</p></article></section></article>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_article_only():
    assert H.main_text(ARTICLE, None) == "Head line <1>\nFirst par\xadt.\nSecond inline © 2 end\ncell\ntwo"


def test_broken_markup_and_plain_text():
    assert H.main_text("", None) == ""
    assert H.main_text("a < b &amp; c <", None) == "a < b & c <"
    assert H.main_text("<article><p>open <b>bold <p>next<div>deep", None) == "open bold\nnext\ndeep"
    assert H.main_text('<p title="unclosed>text</p><p>x</p>', None) in ("text\nx", "x")
    assert H.main_text("<script>" * 50, None) == ""
    assert H.main_text("<p>" + "<b>" * 3000 + "x", None) == "x"


def page(k, body):
    return f'<html><body><div class="top">Always the same line</div><div class="wrap"><div class="inner">{body}</div></div><div class="end">Imprint</div></body></html>'


def test_wrapper_finds_slots_repeats_and_optionals(spark):
    pages = [page(k, "<h1>Title %d</h1>" % k + "".join(f"<p>Text {k} {i} and more words of it</p>" for i in range(1 + k % 4)) + ("<div class='extra'>note %d</div>" % k if k % 3 == 0 else "")) for k in range(12)]
    rows = [(k, "http://h.example.org/%d" % k, h) for k, h in enumerate(pages)] + [(50, None, None), (51, "http://one.example.org", "<p>alone</p>"), (51, "http://one.example.org", "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    w = {r.host: r.wrapper for r in H.host_wrappers(df.repartition(3)).collect()}
    assert set(w) == {"h.example.org", "", "one.example.org"}
    assert H.expression(H.loaded(w["h.example.org"])) == (
        "<html><body><div.top>'</><div.wrap><div.inner><h1>#</>(<p>#</>)+(<div.extra>#</>)?</></><div.end>'</></></>"
    )
    got = {(r.page_id, r.text, r.n_chars) for r in H.extract_main_text(df).collect()}
    for k in range(12):
        want = "\n".join([f"Title {k}", *[f"Text {k} {i} and more words of it" for i in range(1 + k % 4)], *([f"note {k}"] if k % 3 == 0 else [])])
        assert (k, want, len(want)) in got
    assert (50, "", 0) in got and (51, "alone", 5) in got
    assert H.extract_main_text(df).count() == len(rows)
    assert H.extract_main_text(df.limit(0)).collect() == []


def test_wrappers_do_not_depend_on_how_pages_are_dealt():
    trees = [H.folded(H.Page(page(k, "<p>a %d</p>" % k * (1 + k % 3))).root) for k in range(9)]
    one = trees[0]
    for t in trees[1:]:
        one = H.merge(one, t)
    halves = [trees[0], trees[1]]
    for k, t in enumerate(trees[2:]):
        halves[k % 2] = H.merge(halves[k % 2], t)
    assert H.expression(one) == H.expression(H.merge(*halves))


def wrapper_of(pages):
    whole = H.folded(H.Page(pages[0]).root)
    for h in pages[1:]:
        whole = H.merge(whole, H.folded(H.Page(h).root))
    return H.dumped(whole)


def test_wrapper_decides_for_pages_with_an_article():
    own = lambda k: f"Headline {k}\nText {k} with many words of its own\nMore {k} of the text"
    with_box = lambda k: own(k).replace("\n", "\nFollow our channels\n", 1)
    box = lambda k: f"<html><body><article><h1>Headline {k}</h1><div class='x-box'>Follow our channels</div><p>Text {k} with many words of its own</p><p>More {k} of the text</p></article></body></html>"
    pages = [box(k) for k in range(5)]
    for k, h in enumerate(pages):
        # an article keeps what all pages share
        assert H.main_text(h, wrapper_of(pages)) == H.main_text(h, wrapper_of(pages[:2])) == H.main_text(h, None) == with_box(k)
    teaser = lambda k: page(k, f"<h1>Headline {k}</h1><p>Text {k} with many words of its own</p><p>More {k} of the text</p>").replace('<div class="end">', f'<article class="card"><p>Card {k}</p></article><div class="end">')
    pages = [teaser(k) for k in range(5)]
    for k, h in enumerate(pages):
        assert H.main_text(h, wrapper_of(pages)) == own(k)
    other = "<html><body><article><p>A page of another kind with an article that is long</p></article><div class='wrap'><div class='inner'><p>see also</p></div></div></body></html>"
    for pages in (pages, [*pages, other]):  # no choice between the host's main part and an article of another kind
        assert H.main_text(other, wrapper_of(pages)) == "A page of another kind with an article that is long\nsee also"
    same = [box(1)] * 4
    assert H.main_text(box(1), wrapper_of(same)) == H.main_text(box(1), None)


def test_headline_and_lead_beside_the_main_part_stay():
    body = lambda k: "".join(f"<p>Paragraph {j} of text {k}, which is long enough to be most of it</p>" for j in range(6))
    post = lambda k: f"<html><body><div class=post><h1>Headline {k}</h1><p class=lead>Lead {k}</p><div class=body>{body(k)}</div><div class=more><p>See {k}</p></div></div></body></html>"
    pages = [post(k) for k in range(5)]
    for k, h in enumerate(pages):
        assert H.main_text(h, wrapper_of(pages)).split("\n") == [f"Headline {k}", f"Lead {k}", *(f"Paragraph {j} of text {k}, which is long enough to be most of it" for j in range(6))]
    other = "<html><body><div class=post><h1>Alone</h1><section><p>A page without the main part of the others</p></section></div></body></html>"
    assert H.main_text(other, wrapper_of(pages)) == "Alone\nA page without the main part of the others"


def test_constant_texts_inside_an_article_or_main_part_stay():
    five = lambda k: f"<p>Opening {k} of a text with some words</p><h2>Conclusion</h2><p>Closing {k} of a text with some words</p><h2>Sources</h2>"
    want = lambda k: f"Opening {k} of a text with some words\nConclusion\nClosing {k} of a text with some words\nSources"
    article = [f"<body><div class=top>Daily</div><article>{five(k)}</article><div class=end>Imprint</div></body>" for k in range(5)]
    part = [page(k, five(k)) for k in range(5)]
    # a page as a whole: the constants around its text are the template's, those inside are not
    whole = [f"<body><div class=top>Daily</div><div class=tag>Read us</div>{five(k)}<div class=end>Imprint</div></body>" for k in range(5)]
    for k in range(5):
        assert H.main_text(article[k], wrapper_of(article)) == want(k) == H.main_text(part[k], wrapper_of(part))
        assert H.main_text(whole[k], wrapper_of(whole)) == want(k)


def test_lead_in_any_element_stays():
    lead = [f"<body><div class=post><h1>Headline {k}</h1><div class=lead>Lead {k}</div><div class=body>" + "".join(f"<p>Paragraph {j} of text {k}, which is long enough</p>" for j in range(5)) + "</div></div></body>" for k in range(4)]
    for k in range(4):
        assert H.main_text(lead[k], wrapper_of(lead)).startswith(f"Headline {k}\nLead {k}\nParagraph 0 of text {k}")


def test_irregular_pages_keep_wrappers_small():
    r = random.Random(5)
    irregular = lambda k, n: "<body><div class=top>Daily</div><article>" + "".join(f"<{(t := r.choice(['p', 'h2', 'div class=a', 'div class=b', 'ul', 'pre', 'blockquote', 'section']))}>text {k} {j}</{t.split()[0]}>" for j in range(n)) + "</article></body>"
    pages = [irregular(k, 60) for k in range(1000)]
    whole, sizes = H.folded(H.Page(pages[0]).root), []
    for h in pages[1:]:
        whole = H.merge(whole, H.folded(H.Page(h).root))
        sizes.append(len(H.dumped(whole)))
    assert max(sizes) < 50_000 and sizes[-1] < 20_000
    for k in (0, 500, 999):
        assert H.main_text(pages[k], H.dumped(whole)).split("\n") == [f"text {k} {j}" for j in range(60)]
    a, b = (H.folded(H.Page(irregular(k, 8000)).root) for k in (1, 2))
    at = time.monotonic()
    assert len(H.dumped(H.merge(a, b))) < 50_000 and time.monotonic() - at < 1
    some = [irregular(k, 40) for k in range(60)]  # short enough to be aligned
    assert len(wrapper_of(some)) < 50_000


def test_names_inside_an_article_that_only_hold_such_words_stay():
    h = "<article><div class='social-history'><p>one</p></div><section id='share-prices'><p>two</p></section><p class='noticeable ad-hoc'>three</p><div class='share-buttons big'>no</div><div id='cookie_notice'>no</div><p class='comment'>no</p><div class='related-posts'>no</div><p>end</p></article>"
    assert H.main_text(h, None) == "one\ntwo\nthree\nend"


def test_deep_and_long_pages(spark):
    n = 5000
    deep = "<article>" + "<div>" * n + "core of the page" + "</div>" * n + "<p>end</p></article>"
    long = "<body><nav>menu</nav><article>" + "".join(f"<p>Line {k} of it &amp; more.</p></span></section>" for k in range(120_000)) + "</article></body>"
    unclosed = "<div>" * 20_000 + "</section></li>" * 20_000 + "text"
    assert len(long) > 5_000_000
    pages = [(1, "https://deep.example.org/1", deep), (2, "https://deep.example.org/2", deep.replace("core", "heart")), (3, "https://deep.example.org/3", deep.replace("core", "rest")), (4, "https://long.example.org", long), (5, "https://u.example.org", unclosed)]
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["core of the page\nend", "heart of the page\nend", "rest of the page\nend"]
    assert got[4].split("\n") == [f"Line {k} of it & more." for k in range(120_000)] and got[5] == "text"


class Article(HTMLParser):
    """Blocks of text inside `article`, by the standard library's parser: what the given pages' texts must be."""

    BREAKS = {"article", "p", "div", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "pre", "section", "header", "figure", "figcaption", "aside", "nav", "footer", "form"}
    SKIPPED = {"nav", "footer", "aside", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.blocks = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            return self.handle_data(" ")
        if tag in self.BREAKS:
            self.blocks.append("")
        self.inside += tag == "article"
        if tag in self.SKIPPED or ("class", "ad") in attrs or self.skipped and tag == self.skipped[0]:
            self.skipped.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.blocks.append("")
        self.inside -= tag == "article"
        if self.skipped and self.skipped[-1] == tag:
            self.skipped.pop()

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.blocks[-1] += data

    @classmethod
    def text(cls, html):
        p = cls()
        p.feed(html or "")
        p.close()
        return "\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_given_pages_equal_the_standard_parser(spark):
    from tickloom.llm import queries

    sf = "/root/testdata/sf0.001"
    want = {(r.page_id, r.url, Article.text(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op10_wrapper_induction"](spark, sf).collect()
    assert {(r.page_id, r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)
