"""Main text of pages: the given pages against a plain parser, page forms, names, bad markup."""

import time
from html.parser import HTMLParser

import pytest

from lapforge.llm.html_paths import extract_pages, main_text

LONG = "Some long text, that is an article. It has marks, and more of them, too."


class ArticleText(HTMLParser):
    """All text inside article elements, a space at every tag that is no inline one."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.parts.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.parts.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")

    def handle_data(self, data):
        self.parts.append(data if self.inside else "")


def test_given_pages_by_a_plain_parser(spark, sf_dir):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 200
    for r in rows:
        want = " ".join("".join(ArticleText(r.html or "").parts).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


BODY = (f"<p>{LONG}</p><ul><li>item one<li>item <b>two</b></ul><table><tr><td>a<td>b</table><blockquote>short quote</blockquote>"
        f"<pre>code\n x</pre><h2>Heading</h2><p>Sh is.</p><p>{LONG}</p>")
WANT = f"{LONG} item one item two a b short quote code x Heading Sh is. {LONG}"


@pytest.mark.parametrize("page", [
    f"<body><article>{BODY}</article></body>",
    f"<main>{BODY}</main><footer>f, o. o</footer>",
    f"<body>{BODY}<footer>Small print, here.</footer>",
    f"<nav><a>home</a></nav><div id=x>{BODY}</div><div>Small other text, here.</div>",
    f"<div class='elementor-widget wrap'>{BODY}</div><div class='sidebar'><p>Small other text, here.</p></div>",
    f"<div class=elementor-widget><article>{BODY}</article></div><div class=widget>Small other text, here.</div>",
    f"<article><section id=legal>{BODY}</section></article><aside>a, b. c</aside>",
    f"<article>{BODY}<div class=post-comments><p>{LONG}</p></div></article>",
    f"<article>{BODY}</article><section class=comments><article class=comment><p>{LONG}</p></article></section>",
    f"<article>{BODY}<form><p>Your name, please.</p></form><p hidden>no</p><p style='display: none'>no</p></article>",
    f"<div class=ad><p>{LONG * 9}</p></div><article>{BODY}</article>",
    f"<header><h1>Site</h1></header><article>{BODY}</article><div role=search>q, r. s</div>",
    f"<body>{BODY}<ul><li><a href=/>home</a><li><a href=/b>about us</a></ul><div>2020, all rights</div></body>",
    f"<article><p>{LONG}</article><article>{BODY[len(LONG) + 7:]}</article>",
])
def test_page_forms(page):
    assert main_text(page) == WANT


def test_references_and_markup():
    assert main_text(f"<article><p>a &amp; b &#233; &lt;i&gt; 1 < 2, x<br>y {LONG}<script>var t = '</p>'</script><!-- c --></p><![CDATA[d]]></article>") == (
        f"a & b \xe9 <i> 1 < 2, x y {LONG} d")
    assert main_text(f"<article><p title='a > b'>{LONG}</p></article>") == LONG
    assert [main_text(x) for x in (None, "", "   ", "<p>", "<nav>x</nav>", "<!-- never ends", "<script>x")] == [""] * 7
    assert main_text(f"{LONG}") == LONG and main_text(f"<p>{LONG} <a") == f"{LONG} <a"


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<div>x" * 100_000, "<div>" * 3_000 + "<li>y" * 100_000, "<b>" * 50_000 + "<p>z</p>" * 50_000,
    '<a "' * 250_000 + ">", "<p title=\"'>text, here. " * 40_000, "<" * 1_000_000, "</b>" * 250_000, "<b><p>q" * 50_000,
    "<div>" * 100_000, "<!--" * 250_000, "&amp;" * 200_000,
])
def test_bad_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    whole = time.process_time() - start
    start = time.process_time()
    main_text(page[:len(page) // 4])
    assert whole < 10 and whole < 12 * (time.process_time() - start) + 1


def test_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, "x"), (2, "v", "<div>" * 50_000, "x")],
                                 "page_id bigint, url string, html string, text string")
    got = extract_pages(rows).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", len(LONG)), ("1", len(LONG)), ("2", 0), ("None", 0)]
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"} and extract_pages(rows.limit(0)).collect() == []
