"""Main text of pages: the driver's pages and hand-made structures."""

from html.parser import HTMLParser

from tidewater.llm import htmltext as X


class Article(HTMLParser):
    """All text inside <article>, with a space at every block edge."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in X.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in X.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    src = {r.page_id: r.html for r in pages.collect()}
    got = X.extract(pages).collect()
    assert len(got) == len(src)
    for r in got:
        p = Article()
        p.feed(src[r.page_id])
        p.close()
        assert r.text == " ".join("".join(p.out).split()) and r.n_chars == len(r.text)


BODY = "<p>" + "</p><p>".join("A sentence of the main text that goes on for a while, number %d." % i for i in range(8)) + "</p>"
TEXT = " ".join("A sentence of the main text that goes on for a while, number %d." % i for i in range(8))
LINKS = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(30))


def test_structures():
    cases = {
        f"<html><body><div id='menu'><ul>{LINKS}</ul></div><div><div>{BODY}</div></div><div class='site-footer'>Foot</div></body></html>": TEXT,
        f"<body><ul>{LINKS}</ul><main><h1>Head</h1><div>{BODY}</div></main><aside>Side words</aside></body>": "Head " + TEXT,
        f"<article><h1>T &amp; x&#233;</h1>{BODY}<section class='comments'><p>{TEXT}{TEXT}</p></section></article>": "T & xé " + TEXT,
        f"<article>{BODY}<form><label>Mail</label><input></form><div class='cookie-notice'>We use cookies</div></article>": TEXT,
        f"<div class=content>{BODY}</div><div><a href=x>one</a> <a href=y>two</a></div>": TEXT,
        "<article><p>in<b>li</b>ne\n  text<br>next<ul><li>a<li>b</ul></article>": "inline text next a b",
        "<article><p>1 < 2 <!-- x --><script>if (a</p>) {}</script> end</article>": "1 < 2 end",
        "": "", "plain words": "plain words", "<p>": "", "<article></article>": "", "<nav>only menu</nav>": "",
    }
    for src, want in cases.items():
        assert X.main_text(src) == want, src[:80]


def test_head_without_end_tag():
    for start in ("<html><head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title><link href=x>", "<head><script>a</script><body class=x>",
                  "<html><head><style>p {}</style>\n", "<head><title>T</title></head><body>", "<head><meta name=a></html>"):
        assert X.main_text(f"{start}<article><h1>Head</h1>{BODY}</article>") == "Head " + TEXT, start
    assert X.main_text("<head><title>T</title>\n words <b>and</b> more") == "words and more"
    assert X.main_text("<head><title>T</title><iframe src=x></iframe>words") == "words"


def test_marked_wrappers():
    note = "<div class=comments><p>Short reply.</p></div>"
    related = "<div class=related><article><p>A teaser of another page.</p></article></div>"
    cases = {
        f"<body><div class='content-sidebar-wrap'><main>{BODY}</main><div class=sidebar><p>Side words</p></div></div></body>": TEXT,
        f"<body><div id='page' class='no-sidebar'><div>{BODY}</div><div class=ad>Buy</div></div></body>": TEXT,
        f"<div class='article-share-discussion'><article>{BODY}</article></div>{note}": TEXT,
        f"<div class='has-sidebar'><div class='content-sidebar-wrap'><article><h1>T</h1>{BODY}{note}</article></div></div>": "T " + TEXT,
        f"<article><h1>T</h1><div class='article-share-discussion'>{BODY}</div></article>": "T " + TEXT,
        f"<main>{BODY}{related}</main>": TEXT,
        f"<article>{BODY}<section class=comments><article><p>{TEXT}{TEXT}</p></article></section></article>": TEXT,
        f"<div id=content>{BODY}</div>{related}": TEXT,
        f"<div class='no-sidebar'>{BODY}{BODY}</div>{related}": TEXT + " " + TEXT,
        f"<div><p>Menu</p></div><div class='page-header-wrap'><main>{BODY}</main></div><div class=comments><p>{TEXT}{TEXT}</p></div>": TEXT,
        f"<article>{BODY}<div class='promo' style='display:none'>{BODY}</div><span class=ad>Buy</span></article>": TEXT,
    }
    for src, want in cases.items():
        assert X.main_text(src) == want, src[:80]


def test_odd_inputs(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a", "y"), (3, "v", "<div>" * 50000 + "deep", "z"), (4, "w", "<p>" + "é " * 300000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in X.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", 0), (1, "u", 0), (None, None, 1), (3, "v", 4), (4, "w", 599999)], key=str)
    assert X.extract(df.limit(0)).collect() == []


def test_pages_without_article_or_main():
    """The driver's pages with their article elements renamed: the densities
    and the threshold on the body path alone give nearly always the same text."""
    import re

    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist() if h]
    for tag in ("div", "section"):
        renamed = [re.sub(r"<(/?)(?:article|main)(?=[\s>])", rf"<\1{tag}", h) for h in pages]
        assert sum(X.main_text(a) == X.main_text(b) for a, b in zip(pages, renamed)) >= 0.99 * len(pages)


def test_threshold_keeps_dense_siblings_and_leaves_sparse_ones():
    dense = "Words of a long paragraph that go on and on, as those of an article do. " * 6
    links = "<ul>" + "".join(f'<li><a href="/{i}">go {i}</a></li>' for i in range(12)) + "</ul>"
    page = f"<html><body><div><div><p>{dense}A</p><p>{dense}B</p><p>{dense}C</p></div><div>{links}</div><blockquote>{dense}D</blockquote></div></body></html>"
    text = X.main_text(page)
    assert all(f"{x}" in text.replace(" ", "")[-4000:] for x in "ABCD") and "go 3" not in text
    assert X.main_text("<p>short</p>") == "short" and X.main_text("<b>only inline</b>") == "only inline"
