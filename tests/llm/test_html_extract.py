import random
import time

from millrace.llm import html_extract as h
from millrace.llm.html_text import article_text, countable, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><a>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-banner">We use cookies</div><div class="ad">Buy</div>
<article><h1>Title {n} &amp; more</h1><p>First   {n}<br>line &lt;x&gt;<p><b>Second {n}&nbsp;text</article>
<aside>Side</aside><form>Mail <input></form><section id="comments"><p>Nice!</p></section><footer>&copy; Site</footer></body></html>"""


def test_article_of_a_page():
    assert article_text(parse(PAGE.format(n=1)), {}) == "Title 1 & more\nFirst 1 line <x>\nSecond 1 text"


def test_templates_are_removed_by_recurrence(spark, tmp_path):
    page = "<html><body><div><p>Welcome to this site</p></div><div><p>Story {n} of many</p><p>Ends {n}</p></div><div><p>All rights kept</p></div></body></html>"
    rows = [(i, "https://a.com/x", page.format(n=i)) for i in range(40)]
    rows += [(100 + i, "https://b.com/x", page.format(n=7)) for i in range(30)]  # copies of one page
    rows += [(200, None, None), (201, "https://a.com/y", ""), (202, "", "just text"), (0, "https://a.com/x", page.format(n=0))]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'q' AS text", "2 AS templates").write.parquet(f"{tmp_path}/pages.parquet")
    got = h.op3_html_extract(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[5]["text"] == "Story 5 of many\nEnds 5"
    assert by_id[105]["text"] == "Welcome to this site\nStory 7 of many\nEnds 7\nAll rights kept"
    assert (by_id[200]["text"], by_id[201]["text"], by_id[202]["text"]) == ("", "", "just text")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    assert h.extract_articles(pages).columns.count("text") == 1


def test_templates_of_a_section_and_in_cells(spark):
    page = "<html><body>{part}<div><p>Story {n}</p></div><table><tr><td class='sidebar'>Links</td><td>Cell {n}</td><td>Buy now</td></tr></table></body></html>"
    rows = [(i, "https://a.com/x", page.format(n=i, part="<div>Section news</div>" if i < 12 else "")) for i in range(400)]  # on 12 of 400 pages: 3 %
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for upto in (1_000_000, 0):  # Counts sent to tasks, and joined.
        got = {r["page_id"]: r["text"] for r in h.extract_articles(pages, broadcast_upto=upto).collect()}
        assert got == {i: f"Story {i}\nCell {i}" for i in range(400)}


def test_recurring_paragraph_of_an_article_stays(spark):
    page = "<html><body><article><h1>Story {n}</h1><p>Licensed under MIT.</p><div class='promo'>Join</div></article></body></html>"
    pages = spark.createDataFrame([(i, "https://a.com/x", page.format(n=i)) for i in range(30)], "page_id long, url string, html string")
    assert h.extract_articles(pages).where("page_id = 3").first()["text"] == "Story 3\nLicensed under MIT."


def test_deep_and_broken_markup():
    deep = "<div>" * 3000 + "in" + "</div>" * 2999
    assert article_text(parse(deep), {}) == "in"
    assert article_text(parse("<p>a<table><tr><td>b<td>c<tr><td>d</table>e &am &#65; &bogus;"), {}) == "a\nb c\nd\ne &am A &bogus;"


def test_empty(spark):
    assert h.extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_decide_on_pages_without_article(spark, monkeypatch):
    """Unknown names and no <article>: only recurrence tells the template. The same
    pages without the counts keep it."""
    page = "<html><body><div class='qx1'><p>Top of site</p></div><div class='qx2'><h1>Story {n}</h1><p>It begins {n}</p><div class='zz'>Read us daily</div><p>It ends {n}</p></div><div class='qx3'>Bottom</div></body></html>"
    pages = spark.createDataFrame([(i, "https://a.com/x", page.format(n=i)) for i in range(25)], "page_id long, url string, html string")
    assert h.extract_articles(pages).where("page_id = 4").first()["text"] == "Story 4\nIt begins 4\nIt ends 4"
    assert "Top of site" in h.extract_articles(pages, min_pages=26).where("page_id = 4").first()["text"]


def test_names_are_whole_and_count_only_where_they_recur(spark):
    page = "<html><body><article><h1>S {n}</h1><div class='social-history'>History {n}</div><div class='related-work'>Work {n}</div><p><label>Label {n}</label> <math><mi>x</mi></math></p>{once}<div class='comments'>Nice {n}</div></article></body></html>"
    rows = [(i, "https://a.com/x", page.format(n=i, once="<div class='notice'>Notice of motion</div>" if i == 3 else "")) for i in range(25)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in h.extract_articles(pages).collect()}
    assert got[2] == "S 2\nHistory 2\nWork 2\nLabel 2 x"
    assert got[3] == "S 3\nHistory 3\nWork 3\nLabel 3 x\nNotice of motion"


def test_no_page_stops_the_job():
    assert article_text(parse("<p>a<![abc[x]]>b"), {}) == "ab"
    assert article_text(parse("<p>a</p>b <a href='x"), {}) == "a\nb"
    for bad in ("<b>" * 20_000 + "</i>" * 20_000, "<p><table><td>" + "<b>" * 20_000 + "<h1>x</h1>" * 20_000, "<a <b " * 20_000, "<!--" * 20_000 + ">"):
        began = time.perf_counter()
        article_text(parse(bad), {})
        assert time.perf_counter() - began < 10
    draw = random.Random(1)
    bits = ["<", "</", ">", "<!", "<![", "]]>", "--", "<!--", "<p>", "<div", "class=", "'", "a", "&", "#x41;", "[", "]", "CDATA", "<script>", "</script>", "<title>", "<?", "/>", "<![if IE]>", "\n"]
    for _ in range(5_000):
        article_text(parse("".join(draw.choices(bits, k=draw.randrange(1, 14)))), {})


def brute_templates(pages, min_pages):
    """Host and subtree counts by hand."""
    counts = {}
    for host, html in pages:
        for key in countable(parse(html)):
            counts[host, key] = counts.get((host, key), 0) + 1
    return {k: n for k, n in counts.items() if n >= min_pages}


def test_against_templates_by_hand(spark):
    draw = random.Random(5)
    parts = ["<div>Block {k}</div>", "<div class='b{k}'><p>Part {k}</p></div>", "<section><h2>Head {k}</h2><ul><li>a<li>b{k}</ul></section>"]
    rows = []
    for i in range(160):
        blocks = "".join(draw.choice(parts).format(k=draw.choice([1, 2, 3, 1000 + i])) for _ in range(5))
        rows.append((i, f"https://h{i % 3}.com/x", f"<html><body><div><p>Own {i}</p></div>{blocks}</body></html>"))
    hosts = [(f"h{i % 3}.com", html) for i, _, html in rows]
    counts = brute_templates(hosts, 10)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: article_text(parse(html), {k: n for (host, k), n in counts.items() if host == f"h{i % 3}.com"}) for i, _, html in rows}
    for upto in (1_000_000, 0):
        assert {r["page_id"]: r["text"] for r in h.extract_articles(pages, broadcast_upto=upto).collect()} == want
