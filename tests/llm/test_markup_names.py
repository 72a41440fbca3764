"""What names of elements mean, inside and outside of articles, and a plain second reading of whole hosts."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from ledgerloom.llm.htmltext import BLOCKS, DROPPED, MIN_PAGES, MIN_SHARE, SHELL_SHARE, TEXT_BLOCKS, VOID, GOES, NAMED, extract, host_of, judged, main_text, sites_of

P = "<p>The text of this page is long enough to be the most of it.</p>"


@pytest.mark.parametrize(
    "part",
    [
        "<div class='sidebar'>x</div>", "<ul class='menu'><li>x</ul>", "<div class='breadcrumbs'>x</div>", "<div class='cookie-banner'>x</div>", "<div class='notice'>x</div>", "<header><p>x</p></header>",
        "<div class='reader-comments'>x</div>", "<div id='comments-area'>x</div>", "<div class='adSlot'>x</div>", "<div class='sponsored-link'>x</div>", "<div role=navigation>x</div>", "<form>x</form>", "<aside>x</aside>",
    ],
)
def test_names_count_inside_main(part):
    assert main_text(f"<body><main>{part}{P}</main></body>", frozenset()) == P[3:-4] == main_text(f"<body>{part}{P}</body>", frozenset())


@pytest.mark.parametrize("part", ["<div class='reader-comments'>x</div>", "<div class=comment>x</div>", "<section id='comments-area'>x</section>", "<div class='ad-slot'>x</div>", "<div class=sponsored>x</div>", "<div class='newsletter-signup'>x</div>", "<ul class='menu'><li>x</ul>", "<div class='share-bar'>x</div>"])
def test_comments_and_adverts_inside_an_article(part):
    assert main_text(f"<article>{part}{P}</article>", frozenset()) == P[3:-4]


@pytest.mark.parametrize("part", ["<section id=social><p>y</p></section>", "<section id=search><p>y</p></section>", "<div class='entry-header'><h2>y</h2></div>", "<section id=menu><p>y</p></section>", "<div class='shared-history'><p>y</p></div>", "<div class=adventure><p>y</p></div>", "<div class='commentary'><p>y</p></div>"])
def test_sections_of_an_article_stay(part):
    assert main_text(f"<article>{part}{P}</article>", frozenset()) == f"y\n\n{P[3:-4]}"


@pytest.mark.parametrize("attributes", ["class='post alert'", "id='social'", "class='side notes'", "class='layout has-sidebar'", "class=header", "class='content-menu'"])
def test_a_wrapper_with_the_text_is_never_dropped_by_its_name(attributes):
    assert main_text(f"<body><div {attributes}>{P}</div><p>And more.</p></body>", frozenset()) == f"{P[3:-4]}\n\nAnd more."
    assert main_text(f"<div {attributes}><p>Legit</p></div>", frozenset()) == "Legit"


def test_headings_before_an_article_stay():
    page = f"<body><div>Elsewhere</div><h1>Title</h1><article>{P}</article><h2>Others</h2><p>Others</p></body>"
    assert main_text(page, frozenset()) == f"Title\n\n{P[3:-4]}"
    assert main_text(f"<body><header><h1>Site</h1></header><main><h1>Title</h1>{P}</main></body>", frozenset()) == f"Title\n\n{P[3:-4]}"


def test_comments_that_are_articles():
    comments = "<article class='comment-body'><p>First!</p></article><article class=comment><p>Second</p></article>"
    assert main_text(f"<body><article class='post comments-open'>{P}</article>{comments}</body>", frozenset()) == P[3:-4]


def test_judgements():
    assert judged("div", "class='x postComments'", True) == GOES and judged("div", "class='post-alert'", False) != GOES and judged("div", "class=alert", False) == NAMED and judged("main", "class=menu", False) == 0


class Tree(HTMLParser):
    """Elements of a page whose tags are all closed, as lists of tag, attributes and children."""

    def __init__(self, page):
        super().__init__()
        self.root = ["", "", []]
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.open[-1][2].append(" ")
        elif tag not in VOID:
            e = [tag, " ".join(f"{k}='{v}'" for k, v in attrs), []]
            self.open[-1][2].append(e)
            self.open.append(e)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def is_block(e):
    return isinstance(e, list) and (e[0] in BLOCKS or e[0] in DROPPED)


def plain_text(e):
    return e if isinstance(e, str) else "".join(plain_text(c) for c in e[2])


def blocks_below(e):
    """Texts of an element in order, its own between those of the block elements below it; inline elements with blocks in them are looked through."""
    out, run = [], ""

    def walk(children):
        nonlocal run
        for c in children:
            if isinstance(c, str):
                run += c
            elif is_block(c):
                out.append((re.sub(r"\s+", " ", run).strip(), None))
                run = ""
                out.append((None, c))
            else:
                walk(c[2])

    walk(e[2])
    out.append((re.sub(r"\s+", " ", run).strip(), None))
    return [x for x in out if x[0] or x[1]]


def written(e):
    """A subtree as text: its tag, and what stands in it."""
    return f"<{e[0]}>" + "".join(text if text else written(c) for text, c in blocks_below(e)) + "</>"


def test_registered_pages_by_a_plain_second_reading(spark, sf_dir):
    """Pages whose lists of links are no shells here (they lie in nav): subtrees counted as text, and names asked of each element."""
    rows = [r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    trees = {}
    pages_of, held = defaultdict(set), defaultdict(set)
    for r in rows:
        trees[r.page_id] = Tree(re.sub(r"(?s)<(script|style|title)\b.*?</\1>", "", r.html or "")).root
        todo = [c for _, c in blocks_below(trees[r.page_id]) if c]
        for site in sites_of(r.url):
            pages_of[site].add(r.html)
        while todo:
            e = todo.pop()
            for site in sites_of(r.url):
                held[site, written(e)].add(r.html)
            todo += [c for _, c in blocks_below(e) if c]

    def recurs(url, e):
        return any(len(held[s, written(e)]) >= max(MIN_PAGES, MIN_SHARE * len(pages_of[s])) for s in sites_of(url))

    def text_of(r):
        found = []

        def walk(e, article, inside):
            for text, c in blocks_below(e):
                if text:
                    found.append((text, inside))
                elif judged(c[0], c[1], article or c[0] == "article") == 0 and not (recurs(r.url, c) and not (inside and c[0] in TEXT_BLOCKS) and c[0] not in ("article", "main", "body", "html")):
                    walk(c, article or c[0] == "article", inside or c[0] in ("article", "main"))

        walk(trees[r.page_id], False, False)
        some = [t for t, inside in found if inside] or [t for t, _ in found]
        return "\n\n".join(some)

    got = Counter((r.page_id, r.text) for r in extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect())
    assert got == Counter((r.page_id, text_of(r)) for r in rows) and SHELL_SHARE and host_of("http://a.b/") == "a.b"
