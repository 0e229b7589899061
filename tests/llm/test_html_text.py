from dinesight.llm.html_text import extract_pages, main_text

LONG = "This is a paragraph of the article that is long enough to count as text of its own."
MORE = "Another paragraph follows it, with <a href='x'>a link</a> in it, and it ends the article here."
PLAIN = "Another paragraph follows it, with a link in it, and it ends the article here."


def test_marked_article():
    page = (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a>Home</a></li></ul></nav><!-- ad -->"
            f"<div class=\"ad\">Buy this very good product, now and here, it is cheap.</div><article><header><h1>Title &amp;\n more</h1></header><p><b>{LONG}<br>line<p>Short.</p>"
            f"<aside>Side note</aside><p>x&#8217;s &eacute;</p><form>Search <input></form></article><section id=comments><p>{LONG}</p></section><footer>&copy; 2020</footer></body></html>")
    assert main_text(page) == f"Title & more\n{LONG} line\nShort.\nx’s é"


def test_unmarked_page_by_distribution():
    page = (f"<body><div id='menu'><a>Home</a> <a>About</a></div><div class='cookie-notice'>{LONG}</div><ul><li><a>One link</a></li><li><a>Two links</a></li><li><a>Three</a></li></ul>"
            f"<div class='content'><h1>A title</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div><div class='sidebar'>{LONG}</div><div class='comments'><p>{LONG}</p></div></body>")
    assert main_text(page) == f"A title\n{LONG}\nShort.\n{PLAIN}"


def test_broken_and_odd_pages():
    assert main_text("") == main_text("<p></p>") == main_text("<!-- open") == main_text("<script>x") == main_text("<nav>only a menu</nav>") == ""
    assert main_text("plain text") == "plain text"
    assert main_text(f"<article><p>{LONG}</p></artic") == LONG
    assert main_text(f"<article><p title='a > b'>{LONG} 1 < 2</p>") == f"{LONG} 1 < 2"
    assert main_text("<nav><ul><li>menu<article><p>" + LONG) == LONG
    assert main_text(f"<div hidden>{LONG}</div><div style='display:none'>{LONG}</div><p>{PLAIN}") == PLAIN
    assert main_text(f"<article><p>{LONG}</p>" + f"<p>{PLAIN}</p>" * 20_000 + "</article>").count("\n") == 20_000
    assert main_text(f"<ARTICLE><P>{LONG}</P></ARTICLE>") == LONG


def test_table(spark):
    rows = [(1, "u", f"<article>{LONG}</article>"), (1, "u", f"<article>{LONG}</article>"), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html AS text", "1 AS n_chars")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in extract_pages(pages).collect())
    assert got == [(0, "v", "", 0), (1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (2, "", "", 0)]
    assert extract_pages(pages.limit(0)).collect() == []
