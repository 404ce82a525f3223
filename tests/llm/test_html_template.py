from tabellion.llm import html_template as h
from tabellion.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar">
<header><a href="/">Home</a></header><div id="cookieNotice">We use cookies</div>
<div class="page-with-sidebar"><article class="post"><header><h1>Title&nbsp;&eacute;</h1></header>
<p>One <b>two</b>three<br>four &lt;five&#62;
 six<p>Second &amp;amp; <a href="#">link</a>.<ul><li>a<li>b</ul><div class="ad">Buy</div>
<form><p>mail</p><input value="x>y"></form><script>var a="</p><p>no";</script><!-- <p>not</p> -->
<div style="display: none">hidden</div><aside>aside</aside><section class="comments"><p>First!</p></section>
<p>End {n}</article></div><nav><ul><li>menu</ul></nav><footer>foot</footer></body></html>"""
TEXT = "Title é\nOne twothree four <five> six\nSecond &amp; link.\na\nb\nEnd {n}"


def test_article_of_a_page():
    assert h.main_text(PAGE, set()) == TEXT


def test_pages_without_an_article_tag():
    plain = "<html><body><nav>a b</nav><p>Text one</p><div>Text two</div><ul><li><a href=x>Link</a></ul></body>"
    assert h.main_text(plain, set()) == "Text one\nText two"
    named = "<body><div class=top>Top</div><div class='postContent entry'><p>Body</p></div><div>Else</div>"
    assert h.main_text(named, set()) == "Body"


def test_broken_and_empty_pages(spark):
    rows = [
        (1, "http://h/1", None), (2, "http://h/2", ""), (3, None, "<p>a < b & c"), (4, "x", "<article><p>cut <b>of"),
        (5, "http://h/5", "no markup\n at  all"), (6, "http://h/6", "<p>" + "word " * 200_000 + "</p>"), (6, "http://h/6", "<p a='"),
    ]
    pages = spark.createDataFrame([(i, u, p, "mine") for i, u, p in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in h.extract(pages).collect())
    assert got == [(1, ""), (2, ""), (3, "a < b & c"), (4, "cut of"), (5, "no markup at all"), (6, ""), (6, ("word " * 200_000).strip())]
    assert h.extract(pages.where("false")).count() == 0


def test_template_of_a_host_is_removed(spark):
    def page(n):
        return (
            f"<body><div class=x1><p>Welcome to the site</p><p>Today's offer</p></div><div class=x2><p>Story {n} begins</p>"
            f"<p>and {'goes on' if n % 2 else 'ends'} {n}</p><p>Share this story</p></div><div class=x3><p>All rights</p></div></body>"
        )

    rows = [(n, f"https://News.example/{n}", page(n)) for n in range(12)]
    rows += [(100 + n, f"https://few.example/{n}", page(n)) for n in range(3)]
    rows += [(200 + n, "https://copies.example/", page(1)) for n in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert got[3] == "Story 3 begins\nand goes on 3" and got[4] == "Story 4 begins\nand ends 4"
    assert got[101].startswith("Welcome") and got[101].endswith("All rights")  # too few pages for a template
    assert got[205] == got[101]  # copies of one page have no slots: nothing is dropped
    tokens = h.template_texts(pages).collect()
    assert {r.host for r in tokens} == {"news.example", "copies.example"}


def test_registered_pages(spark):
    import html
    import re

    got = {r.page_id: r for r in QUERIES["op3_main_text"](spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    for row in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S).group(1)
        parts = [html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split() for p in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n".join(" ".join(p) for p in parts if p)
        assert (got[row.page_id].text, got[row.page_id].n_chars) == (text, len(text))


def test_template_survives_odd_and_empty_pages(spark):
    def page(n):
        return (
            f"<body><div class=x1><p>Welcome to the site</p><p>Today's offer</p></div><div class=x2><p>Story {n} begins</p>"
            f"<p>and ends {n}</p><p>Share this story</p></div><div class=x3><p>All rights</p></div></body>"
        )

    rows = [(n, f"https://news.example/{n}", page(n)) for n in range(10)]
    rows += [(10, "https://news.example/none", ""), (11, "https://news.example/odd", "<body><p>Moved away</p></body>")]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 begins\nand ends 3"
    assert (got[10], got[11]) == ("", "Moved away")


def test_slots_between_template_tags_are_judged_by_what_fills_them(spark):
    def page(n):
        offer, link = ("Red", "Blue")[n % 2], f"<a href=/{n}>Read number {n}</a>"
        return (
            f"<body><div class=t><i>{offer} offer</i></div><h1>Title {n}</h1><p>Story {n} begins</p>" + f"<p>goes on {n}</p>" * (n % 3)
            + f"<p>{link}</p>" * (n % 2) + f"<div class=m>{link}{' today' * (9 if n == 5 else 0)}</div><h6>{offer} end</h6></body>"
        )

    rows = [(n, f"https://slots.example/{n}", page(n)) for n in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    tokens = h.template_tokens(pages).collect()
    assert tokens and not any(r.is_text for r in tokens)  # no text is on half of the pages: the template is tags
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert got[4] == "Title 4\nStory 4 begins\ngoes on 4"
    # the paragraph that is a link lies among paragraphs, the link with many words in a menu
    assert got[5] == "Title 5\nStory 5 begins\ngoes on 5\ngoes on 5\nRead number 5"
