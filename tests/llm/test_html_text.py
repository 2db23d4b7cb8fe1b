import os
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import html_text as H

SF = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- ad 1 --><div class="ad">Buy &amp; save</div><div class="cookie-notice">We use cookies</div><%s><h1>Title &lt;1&gt;</h1><p><b>First
 para&nbsp;graph<br>goes on<p>Second <a href="x">with link</a> &am<ul><li>one<li>two</ul><form><p>mail</p></form><aside>side</aside><div class="comments"><p>Nice!</p></div>%s
<footer>&copy; me</footer></body></html>"""
TEXT = "Title <1>\nFirst para graph goes on\nSecond with link &am\none\ntwo"


def test_extract_article_and_div():
    for start, end in (("article", "</article>"), ("article", ""), ('div class="post-17 body"', "</div>"), ("main id=content", "</main>")):
        assert H.extract(PAGE % (start, end), []) == TEXT


def test_paths_are_generalised():
    cut = H.Page('<body><div class="b post-17"><p>x</p></div><div class="b post-18"><p>y</p></div></body>')
    assert [cut.spell(n) for n, _, _ in cut.blocks] == [("body", "div.b.post-#")] * 2


@pytest.mark.parametrize(
    "start", ['article class="content with-sidebar"', 'div class="post no-sidebar"', 'div class="has-header"', 'div class="entry share-enabled"', 'div class="comments-open"', 'div id="page-social"', 'main class="has-sidebar"', 'div class="content with-comments"', 'div class="notice"', "form method=post"],
)
def test_common_theme_classes_keep_the_article(start):
    page = f'<body class="has-sidebar"><nav><a href="/">Home</a></nav><{start}><p>The article text is here.</p></{start.split()[0]}><footer>me</footer></body>'
    assert H.extract(page, []) == "The article text is here."


def test_suspects_go():
    body = "<p>The article text is here, with words enough to be more than what stands around it.</p>"
    for extra in ('<div class="ad">Buy</div>', '<div class="site-header">Site</div>', '<ul class="main-nav"><li>Home</ul>', '<div id="sidebar-left">x</div>', '<p class="share">share</p>', '<div role="alert">!</div>', "<form><p>mail</p></form>", "<header>Site</header>"):
        for page in (f"<body>{extra}<article>{body}</article></body>", f'<body><div class="entry-content">{body}</div>{extra}</body>', f"<body><div><div>{body}</div>{extra}</div></body>"):
            assert H.extract(page, []) == body[3:-4], (extra, page)
    assert H.extract("<body><article><header><h1>T</h1></header><p>x <math><mi>y</mi></math> z<div class=entry-header>E</div></article></body>", []) == "T\nx y z\nE"
    # Comments longer than the article, which says where it is.
    assert H.extract(f'<body><div class="post-content">{body}</div><div class="comments">{"<p>Very nice indeed, thank you!</p>" * 30}</div></body>', []) == body[3:-4]


def test_cutting_is_linear_in_depth():
    def seconds(page):
        began = time.perf_counter()
        H.extract(page, [("div",)], {"x"})
        return time.perf_counter() - began

    for shape in ("<div>{}", "<div class=ad>{}", "<span>{}</x>", "<p><b>{}</i>"):
        small, large = (min(seconds(shape.replace("{}", "") * n + "text") for _ in range(3)) for n in (2_000, 16_000))
        assert large < 30 * max(small, 0.002), shape


class _Plain(HTMLParser):
    """Another reading of the given pages: text blocks inside the article element."""

    def __init__(self):
        super().__init__()
        self.inside, self.lines, self.held = False, [], ""

    def cut(self):
        if self.held.split():
            self.lines.append(" ".join(self.held.split()))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag == "br":
            self.held += " "
        elif tag != "b":
            self.cut()

    def handle_endtag(self, tag):
        if tag != "b":
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.held += data


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        plain = _Plain()
        plain.feed(r["html"] or "")
        plain.close()
        want[r["page_id"]] = "\n".join(plain.lines)
    got = {r["page_id"]: r["text"] for r in H.op5_host_paths(spark, SF).collect()}
    assert got == want


def test_odd_input():
    for page in (None, "", "   ", "<", "<p", "</", "&", "<!--", "<script>x", "<p><p><p>", "</div></b>"):
        assert isinstance(H.extract(page, []), str)
    assert H.extract("just text &amp; more", []) == "just text & more"
    assert H.extract("<p>a</p" + "<b>" * 5000 + "x", []).startswith("a")
    assert H.extract("<div title='a > b'>in</div>", []) == "in"
    assert len(H.extract("<article><p>" + "word " * 200_000 + "</p></article>", [])) == 999_999


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "path": F.lit(1), "paths": F.lit(2)})


def test_consensus_overrules_a_page(spark):
    usual = '<body><div class="txt"><p>The article of page {k} with enough words in it.</p></div><div class="more"><p>short</p></div></body>'
    odd = '<body><div class="txt"><p>Tiny.</p></div><div class="more"><p>' + "A long list of other things. " * 20 + "</p></div></body>"
    rows = [(k, "https://h.example/" + str(k), usual.replace("{k}", str(k))) for k in range(30)] + [(99, "https://h.example/odd", odd), (100, "https://other.example/", odd)]
    got = {r["page_id"]: r["text"] for r in H.main_text(_pages(spark, rows)).collect()}
    assert got[3] == "The article of page 3 with enough words in it." and got[99] == "Tiny." and got[100].startswith("A long list")


def test_pages_vote_on_suspects(spark):
    """A class that one page uses for most of its text goes where the host's other pages use it for adverts, and the other way round."""
    usual = '<body><div class="txt"><p>The article of this page with enough words in it.</p></div><div class="promo"><p>Buy now</p></div></body>'
    long = '<body><div class="txt"><p>Short text.</p></div><div class="promo"><p>' + "Really, do buy this now. " * 20 + "</p></div></body>"
    held = '<body><div class="notice"><p>The notice is the text of all these pages.</p></div></body>'
    little = '<body><div class="notice"><p>Short.</p></div><div class="cards"><div><p>' + "Other things stand here. " * 9 + "</p></div></div></body>"
    rows = [(k, "https://a.example/" + str(k), usual) for k in range(12)] + [(50, "https://a.example/x", long), (51, "https://single.example/x", long)]
    rows += [(k, "https://b.example/" + str(k), held) for k in range(60, 72)] + [(80, "https://b.example/x", little), (81, "https://other.example/x", little)]
    got = {r["page_id"]: r["text"] for r in H.main_text(_pages(spark, rows)).collect()}
    assert got[3] == "The article of this page with enough words in it." and got[50] == "Short text." and got[51].startswith("Really")
    assert got[65] == "The notice is the text of all these pages." and got[80] == "Short." and got[81].startswith("Other")
    said = {r["host"]: (len(r["go"]), len(r["stay"])) for r in H.host_paths(_pages(spark, rows)).collect()}
    assert said == {"a.example": (1, 0), "single.example": (0, 0), "b.example": (0, 1), "other.example": (0, 0)}


#: Names that themes give to what is no article text.
NAMES = (
    "share-buttons related-posts related-articles comment-list comments-area disqus_thread author-bio cookie-banner cookie-consent-banner newsletter-signup newsletter-form google-ad ad-slot-1 "
    "adsbygoogle wp-block-navigation breadcrumb-trail post-comments social-links social-media-links sponsored-content promo-box subscribe-box sidebar-widget widget-area widget_text site-footer "
    "page-footer footer-widgets nav-links post-navigation menu-item main-menu top-nav navbar-brand popular-posts recommended read-next ad-wrapper advertisement-block banner-ad outbrain taboola "
    "gdpr-notice privacy-notice alert notification login-form search-form paywall tags entry-meta skip-link reply comment-respond user-comments reader-comments discussion"
).split()
#: Names that hold article text.
KEPT = "entry-content post-body article-text content-block main-text media-caption section-content lead post-text item-list has-header no-sidebar article-header reader-content author-note user-guide".split()


def test_named_boxes_in_an_article(spark):
    """Hosts of five pages, each with a box inside the article under one name."""
    page = '<body><article><h1>Head {k}</h1><p>The article of page {k} says enough.</p><div class="{c}"><p>Box {k} with words of its own.</p></div><p>The end of it.</p></article></body>'
    rows = [(100 * j + k, f"https://h{j}.example/{k}", page.replace("{k}", str(k)).replace("{c}", c)) for j, c in enumerate([*NAMES, *KEPT]) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in H.main_text(_pages(spark, rows)).collect()}
    assert all("says enough." in t and t.endswith("The end of it.") for t in got.values())
    left = {c for j, c in enumerate([*NAMES, *KEPT]) for k in range(5) if "Box" in got[100 * j + k]}
    # Sections of an article are called "discussion" too, and nothing in "read-next" names what it is.
    assert left == {"discussion", "read-next", *KEPT}


def test_edges(spark):
    rows = [(1, None, None), (None, "x", ""), (2, "http://u@Host:80/p", PAGE % ("article", "</article>")), (2, "http://u@Host:80/p", PAGE % ("article", "</article>"))]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in H.main_text(_pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "", 0), (None, "", 0), (2, TEXT, len(TEXT)), (2, TEXT, len(TEXT))], key=str)
    assert H.main_text(_pages(spark, [])).count() == 0
    hosts = _pages(spark, rows).select(H.host(F.col("url")).alias("h")).distinct().collect()
    assert {r["h"] for r in hosts} == {"", "host"}
