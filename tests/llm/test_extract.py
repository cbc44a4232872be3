from glyphgrid.llm import extract

PAGE = """<html><head><title>T</title><script>var a=1;</script></head><body><nav><a href=/>Home</a></nav><div class="content"><h1>A head</h1>
<p>Some text, with commas, and   more of it &amp; so on, to be scored, by length.</p><ul><li>one, of two<li>two</ul><p>A last one, that is kept.</p>
<div class="comments"><p>A reader said, this.</p></div></div><footer>Foot</footer></body></html>"""


def test_page():
    assert extract.main_text(PAGE) == "A head Some text, with commas, and more of it & so on, to be scored, by length. one, of two two A last one, that is kept."
    for text in (None, "", "   ", "<", "<p", "<!-- x"):
        assert extract.main_text(text).strip() in ("", "<")
    assert len(extract.main_text("<div><p>" + "word, " * 100_000 + "</p></div>")) > 500_000


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, 1)], "page_id long, url string, html string, text int")
    got = extract.extract(pages).collect()
    assert sorted(r.n_chars for r in got)[0] == 0 and all(len(r.text) == r.n_chars for r in got)
    assert extract.extract(pages.limit(0)).count() == 0


def test_class_words_never_cut_the_article():
    good = "<p>One good paragraph, with commas, and a fair number of words in it, so that it counts.</p>" * 3
    text = " ".join(["One good paragraph, with commas, and a fair number of words in it, so that it counts."] * 3)
    for page in ('<div class="overflow-hidden">@</div>', '<div class="has-sidebar"><article>@</article></div>', '<div id="no-menu"><main>@</main></div>', '<section class="discussion">@</section>', '<div class="site-menu"><article>@</article></div>'):
        assert extract.main_text(page.replace("@", good)) == text, page
    assert extract.main_text(f'<article>{good}<p class="notice-of-facts">Facts, here.</p></article>') == text + " Facts, here."
    for cut in ("ad", "cookie-notice", "siteFooter", "comments"):
        assert extract.main_text(f'<body><div class="{cut}">{good}{good}</div><article>{good}</article></body>') == text


def test_parts_of_the_article_stay():
    good = "<p>One good paragraph, with commas, and a fair number of words in it, so that it counts.</p>" * 3
    text = " ".join(["One good paragraph, with commas, and a fair number of words in it, so that it counts."] * 3)
    for part in ('<h1 class="page-header">The Title</h1>', "<header><h1>The Title</h1></header>", '<p class="ad-free">The Title</p>', '<div class="share-price">The Title</div>', '<section id="legal-history">The Title</section>', '<section id="Social_history">The Title</section>', "<p><math><mi>The</mi> <mi>Title</mi></math></p>"):
        assert extract.main_text(f"<body><article>{good}{part}{good}</article></body>") == f"{text} The Title {text}", part
    assert extract.main_text(f"<body><div>{good}</div><div><p>short, text</p></div><footer>no</footer></body>") == f"{text} short, text"
    for part in ("comments", "share-buttons", "related posts", "related-posts", "sidebar-left", "ad ad-slot", "nav-list", "newsletter_signup", "adUnit"):
        assert extract.main_text(f'<body><article>{good}<div class="{part}"><p>Not this, please.</p></div></article></body>') == text, part
    assert extract.main_text(f"<body><header><h1>Site</h1></header><article>{good}</article></body>") == text


def test_broken_pages_take_linear_time():
    import time

    pages = ["<div " + " ".join(f'a{i}="x"' for i in range(20000)), "<div " + " ".join(f'a{i}="x' for i in range(20000)), "<div>x" * 20000, "<span>x" * 20000 + "</p>" * 20000, "<svg>x" * 20000, "<" * 200000, "<a " + "= " * 50000]
    for page in pages:
        began = time.process_time()
        extract.main_text(page)
        assert time.process_time() - began < 5, page[:20]


def plain(html: str) -> str:
    """The texts of an article's blocks by the library's parser, for well-formed pages."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag in ("p", "h1", "li", "br"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "li", "ul"):
                self.out.append(" ")
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth:
                self.out.append(data)

    reader = Reader()
    reader.feed(html)
    return " ".join("".join(reader.out).split())


def test_equals_a_plain_reading_of_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    assert len(got) == len(html) and all(got[k] == plain(h) for k, h in html.items() if "<article" in (h or ""))
