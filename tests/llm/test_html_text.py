"""Main text of pages: whole pages against a plain reading of their article, and odd markup."""

import html
import re

import pytest

from rasterledger.llm import html_text

TREE = html_text.train()


def test_tree_learns_its_table():
    x, y = html_text.labelled_blocks()
    assert (((TREE.predict(x)) >= 0.5) == y).mean() > 0.97


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain", ""),
        ("<article>one", "one"),
        ("<nav>menu</nav><article><h1>T &amp; U</h1><p> a \n\t b <b>c<br><p>d&nbsp;&eacute; &#x41;&lt;p&gt;</article>", "T & U a b c d é A<p>"),
        ("<article><script>var a='</p>';</script><style>p{}</style><!-- x <p>y</p> --><p>z</p></article><p>Out", "z"),
        ("<article><p>x</p><div class='comments'><p>I like this very much indeed and say so</p></div><p>y</p></article>", "x y"),
        ("<ARTICLE CLASS=ad-free><P>x</P></ARTICLE><FOOTER>f</FOOTER>", "x"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><aside>no</aside><form>no</form><header>no</header>yes<footer>no</footer></article>", "yes"),
        ("<div class='ad'>no</div><article>" + "<b><p>w</p>" * 3000 + "</article>", " ".join(["w"] * 3000)),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page, TREE) == text


def test_without_article_long_paragraphs_count():
    body = "This is a paragraph of many words that nobody would mistake for a menu or a footer of a page. "
    page = f"<body><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul><p>{body * 2}</p><p>{body * 3}</p><div class='footer'>Imprint</div></body>"
    assert html_text.main_text(page, TREE) == (body * 5).strip()


def test_query_form(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "x"), (1, "u", "<article><p>a</p></article>", "x"), (None, None, None, "x"), (3, "v", "<article>" + "<p>word here</p>" * 20000 + "</article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()), key=lambda r: r[0])
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1), (3, " ".join(["word here"] * 20000), 199999)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_given_pages_match_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.sub("</?b>", "", re.search("<article>(.*?)</article>", r["html"], re.DOTALL)[1])
        blocks = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split("</?(?:p|h1|br)>", inner)]
        assert got[r["page_id"]] == " ".join(x for x in blocks if x)
