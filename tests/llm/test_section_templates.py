"""Templates of a section of a large host."""


def test_template_of_a_section_goes_on_a_large_host(spark):
    from ledgerloom.llm.htmltext import extract

    side = "<div>Notes of this part of the site only</div>"
    page = lambda i, more: f"<html><body><div><p>Own text number {i} of a page</p></div>{more}</body></html>"
    rows = [(i, f"https://big.example/s{i % 20}/p{i}", page(i, side if i % 20 == 3 else "")) for i in range(400)]
    rows += [(1000 + i, f"https://big.example/p{i}", page(1000 + i, "")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, 0):
        got = {r.page_id: r.text for r in extract(pages, max_broadcast=limit).collect()}
        assert got == {i: f"Own text number {i} of a page" for i, _, _ in rows}
