"""What counting alone takes out, names inside articles, deep pages, and the registered pages."""

import time


def test_names_inside_an_article(spark):
    from ledgerloom.llm.htmltext import extract

    article = "<article><div class='entry-header'><h1>Title</h1></div><p>Body one.</p><section id='social'><p>About social life</p></section><section id=search><p>On search</p></section><div class='ad'>Buy</div><section id=comments><p>First!</p></section></article>"
    pages = spark.createDataFrame([(1, "http://a.example/x", f"<body><div class='site-search'>find</div>{article}<div class=related>more</div></body>")], "page_id long, url string, html string")
    assert extract(pages).first().text == "Title\n\nBody one.\n\nAbout social life\n\nOn search"


def test_lists_of_links_that_differ_from_page_to_page(spark):
    from ledgerloom.llm.htmltext import extract

    links = lambda i, n: "".join(f"<li><a href=/{i}/{j}>entry {i} {j}</a></li>" for j in range(n))
    page = lambda i: f"<body><div class=x7><b>See</b><ul>{links(i, 3 + i % 4)}</ul></div><div class=lead><p>Lead of {i}</p></div><div><p>Own text {i} with <a href=/>a link</a></p></div></body>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(8)] + [(100, "https://alone.example/", page(100))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, 0):
        got = {r.page_id: r.text for r in extract(pages, max_broadcast=limit).collect()}
        assert all(got[i] == f"Lead of {i}\n\nOwn text {i} with a link" for i in range(8)) and "entry 100 0" in got[100]


def test_counting_decides_on_the_registered_pages(spark):
    from pyspark.sql import functions as F

    from ledgerloom.llm.htmltext import extract, host_of, main_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    of_host = {}
    for r in rows.values():
        of_host.setdefault(host_of(r.url), set()).add(r.html)
    counted = {r.page_id: r.text for r in extract(pages, names=False).collect()}
    uncounted = {i: main_text(r.html, frozenset(), names=False) for i, r in rows.items()}
    many = [i for i, r in rows.items() if len(of_host[host_of(r.url)]) >= 5]
    assert many and all(uncounted[i] != "" for i in many if rows[i].html)
    changed = [i for i in many if counted[i] != uncounted[i]]
    # Every page has its text in an article, so that what counting takes out shows only where that mark is taken away.
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    without = {i: main_text(r.html.replace("<article>", "").replace("</article>", ""), frozenset(), names=False) for i, r in rows.items() if r.html}
    with_ = {r.page_id: r.text for r in extract(bare, names=False).collect()}
    changed += [i for i in many if i in without and with_[i] != without[i]]
    assert len(set(changed)) >= 0.9 * len(many)
    truth = {r.page_id: r.text for r in extract(pages).collect()}
    assert all(truth[i].split("\n\n")[-1] in with_[i] for i in many if truth[i])


def test_deep_pages_take_time_in_proportion():
    from ledgerloom.llm.htmltext import main_text

    began = time.perf_counter()
    assert main_text("<div>" * 30_000 + "<p>a<p>b" + "</span>" * 1000, frozenset()) == "a\n\nb"
    assert main_text("<li>x" * 20_000, frozenset()).count("x") == 20_000
    assert main_text("<table>" + "<tr><td>y" * 20_000, frozenset()).count("y") == 20_000
    assert time.perf_counter() - began < 20
