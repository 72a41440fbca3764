"""Main text of web pages: site templates are found by counting element subtrees per host and taken out.

First pass: every block element of a page is hashed with all that stands below it. An element outside the article and the main part most of whose text is links is
hashed a second time as a shell: tags and classes without texts, equal neighbours taken once, so that menus and lists whose
entries differ from page to page are one. Spark counts for each host, and for each
section of a host (the first directory of the path), on how many different pages each hash stands (copies of one page count once;
partial sums before the shuffle). Second pass: subtrees that stand on many pages of their host or section, at least five and a
tenth of them (half of them for shells), are deleted, so that a section's own template goes however large the host is. What is too rare to be counted is
told by the markup itself, by elements, roles, and parts of classes and ids that name menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comment sections; inside an
article only unmistakable names count, and an element that holds most of what is left never goes by its name (but for comments and adverts). The text blocks of the article, or else of the main
part, and headings before it remain.
A text block inside the page's article is kept however often it occurs: there, frequency tells quotes, not templates.
If there are few recurring subtrees they are broadcast, after their number has been checked; beyond that they are
joined to the hashes of each page.

Cases: a null or empty page has an empty text; a null or unreadable url counts as a host of its own; repeated rows are
extracted each; an empty table gives an empty result; other columns are ignored. Very long and very deep pages are read whole, in time
proportional to their length; ties don't arise.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, stored, texts

#: Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY_OWN_KIND = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option input textarea iframe object embed svg canvas audio video"
    " map dialog menu title xmp noembed noframes".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Parts of classes and ids (between spaces, hyphens, underscores and capitals): of comments and adverts, of what surrounds an article, of what may as well be called so inside one, and
#: of articles themselves. The last two lists are beginnings of such parts.
COMMENTS = frozenset("comment comments commentlist commentarea commentbox disqus respond replies ad ads adv adslot adbox adunit adsbygoogle".split())
AROUND = frozenset(
    "cookie cookies consent gdpr newsletter subscribe menu nav navbar navigation breadcrumb breadcrumbs sidebar footer pagination pager login signup popup modal overlay toolbar".split()
)
PERHAPS = frozenset("banner notice notification alert side widget header masthead share sharing social related recommended search".split())
OWN = frozenset("article post entry hentry content story main body text".split())
BEGIN_COMMENTS, BEGIN_PERHAPS = ("advert", "sponsor"), ("promo",)
#: Parts that count inside an article only as a class: ids there are anchors of its sections.
CLASS_ONLY = AROUND - {"cookie", "cookies", "consent", "gdpr", "newsletter"} | {"share", "sharing", "related"}
PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption td th li".split())
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

MIN_PAGES, MIN_SHARE, SHELL_SHARE, MAX_BROADCAST = 5, 0.1, 0.5, 200_000


#: What the markup says of an element: nothing, that its name is one of what surrounds articles (unless it holds most of the text), or that it is none of the article.
STAYS, NAMED, GOES = range(3)


def judged(tag: str, attributes: str, in_article: bool) -> int:
    """STAYS, NAMED or GOES. Inside an article only names that can't be those of its sections count."""
    if tag in DROPPED:
        return GOES
    if tag == "header" and not in_article:
        return GOES
    if tag in ("html", "body", "main") or not attributes:
        return STAYS
    worst = STAYS
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if tag == "article":  # readers' comments may be articles too
            tokens = value.lower().split()
            if name == "class" and any(x.startswith("comment") for x in tokens) and OWN.isdisjoint(tokens):
                return GOES
            continue
        if name == "role":
            if value.lower() in DROPPED_ROLES:
                return GOES
            continue
        parts = {x.lower() for x in PARTS.split(value)}
        if parts & COMMENTS or any(x.startswith(BEGIN_COMMENTS) for x in parts):
            return GOES
        if in_article:
            if parts & (AROUND - CLASS_ONLY) or name == "class" and parts & CLASS_ONLY:
                worst = NAMED
            continue
        if parts & AROUND or (parts & PERHAPS or any(x.startswith(BEGIN_PERHAPS) for x in parts)) and not parts & OWN:
            worst = NAMED
    return worst


class Element:
    __slots__ = ("tag", "attributes", "dropped", "named", "in_article", "inside", "parts", "shells", "first", "said", "linked")

    def __init__(self, tag: str, attributes: str, is_dropped: bool, named: int, in_article: bool, inside: bool, first: int, said: int, linked: int):
        self.tag, self.attributes, self.dropped, self.named, self.in_article, self.inside, self.first, self.said, self.linked = tag, attributes, is_dropped, named, in_article, inside, first, said, linked
        self.parts, self.shells = [], []


@dataclass(frozen=True, slots=True)
class Block:
    """A text block: whether the markup takes it out, the outermost named element that it lies in (-1: none), whether it lies in an article or in the main part, and whether it is a heading."""

    text: str
    dropped: bool
    named: int
    inside: bool
    heading: bool


def label_of(attributes: str) -> str:
    """Class, id and role of an element, without numbers."""
    if not attributes:
        return ""
    found = [(name.lower(), "".join(values)) for name, *values in ATTRIBUTE.findall(attributes)]
    return " ".join(f"{name}={re.sub('[0-9]+', '', value)}" for name, value in sorted(found))


def short_hash(parts: list[str], shell: int) -> int:
    """A signed 64-bit hash whose last bit says whether it is a shell's."""
    h = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) & ~1 | shell
    return h - (1 << 64) if h >> 63 else h


def read_page(page: str | None, names: bool = True) -> tuple[list[Block], list[tuple[int, int | None, str, bool, int, int]]]:
    """The text blocks of a page in order, and for each closed
    block element its hash, its shell's (None unless most of its text is links and it lies in no article), tag, whether it lies in an article, and
    the range of blocks that it holds. Without names, elements are not judged by what they are called."""
    blocks: list[Block] = []
    elements: list[tuple[int, int | None, str, bool, int, int]] = []
    stack, opened = [Element("", "", False, -1, False, False, 0, 0, 0)], 0
    places: dict[str, list[int]] = {}  # where in the stack the open elements of each tag are
    run: list[str] = []
    said = linked = 0
    in_link = False

    def flush() -> None:
        if run:
            text = SPACE.sub(" ", html.unescape("".join(run))).strip(" ")
            run.clear()
            if text:
                e = stack[-1]
                blocks.append(Block(text, e.dropped, e.named, e.inside, e.tag in HEADINGS))
                stack[-1].parts.append(text)

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            places[e.tag].pop()
            digest = short_hash([e.tag, *e.parts], 0)
            stack[-1].parts.append(f"{digest:x}")
            shell = None
            if not e.inside:
                shell = short_hash([e.tag, label_of(e.attributes), *e.shells], 1)
                if stack[-1].shells[-1:] != [f"{shell:x}"]:
                    stack[-1].shells.append(f"{shell:x}")
            if len(blocks) > e.first and e.tag in BLOCKS:
                links = not e.inside and 2 * (linked - e.linked) >= said - e.said > 0
                elements.append((digest, shell if links else None, e.tag, e.inside, e.first, len(blocks)))

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def hear(text: str) -> None:
        nonlocal said, linked
        run.append(text)
        n = len(text.strip())
        said += n
        linked += n * in_link

    page, at = page or "", 0
    while m := TOKEN.search(page, at):
        hear(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCKS or tag in DROPPED
        if tag == "br":
            run.append(" ")
            continue
        if tag == "a":
            in_link = not slash
        if block:
            flush()
        if slash:
            if depth := last((tag,)):
                close(depth)
            continue
        if tag in CLOSES_PARAGRAPH and (depth := last(("p",))):
            close(depth)
        if tag in CLOSED_BY_OWN_KIND:
            own = last(("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,))
            if own > last(CLOSED_BY_OWN_KIND[tag]):
                close(own)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not block:
            continue  # inline elements neither split text nor count as subtrees of their own
        above = stack[-1]
        in_article = above.in_article or tag == "article"
        says = judged(tag, attributes, in_article) if names else GOES if tag in DROPPED and tag not in BLOCKS else STAYS
        opened += 1
        named = opened if says == NAMED and above.named < 0 else above.named
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, attributes, above.dropped or says == GOES, named, in_article, above.inside or tag in ("article", "main"), len(blocks), said, linked))
    hear(page[at:])
    flush()
    close(1)
    return blocks, elements


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def sites_of(url: str | None) -> list[str]:
    """The host of a url, and the host with the first directory of the path if there is one."""
    host = host_of(url)
    try:
        first, _, rest = urlsplit(url or "").path.lstrip("/").partition("/")
    except ValueError:
        return [host]
    return [host, f"{host}/{first}"] if first and rest else [host]


class Either:
    """What lies in any of several sets."""

    def __init__(self, *sets: frozenset[int] | set[int]):
        self.sets = sets

    def __contains__(self, x: int) -> bool:
        return any(x in s for s in self.sets)


def main_text(page: str | None, recurring: frozenset[int] | set[int] | Either, names: bool = True) -> str:
    """The article's blocks and headings before it, without the recurring subtrees; all other blocks where a page marks no article. An element that is only named like what
    surrounds an article stays if it holds more than half of the text that is left."""
    blocks, elements = read_page(page, names)
    gone = set()
    for digest, shell, tag, inside, first, end in elements:
        if (digest in recurring or shell is not None and shell in recurring) and not (inside and tag in TEXT_BLOCKS) and tag not in ("article", "main", "body", "html"):
            gone.update(range(first, end))
    kept = [b for i, b in enumerate(blocks) if not b.dropped and i not in gone]
    held = Counter()
    for b in kept:
        held[b.named] += len(b.text)
    kept = [b for b in kept if b.named < 0 or 2 * held[b.named] > held.total()]
    first = next((i for i, b in enumerate(kept) if b.inside), None)
    if first is not None:
        kept = [b for i, b in enumerate(kept) if b.inside or b.heading and i < first]
    return "\n\n".join(b.text for b in kept)


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """place, site, page (hash of its html), subtree: the distinct hashes, of subtrees and of shells, of every page for its host and its section; place
    is the narrower of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sites, ids, hashes = [], [], [], []
            for url, body, page in zip(texts(batch, "url"), batch.column("page").to_pylist(), texts(batch, "html")):
                own, held = {x for e in read_page(page)[1] for x in e[:2]} - {None}, sites_of(url)
                for site in held:
                    places += [held[-1]] * len(own)
                    sites += [site] * len(own)
                    ids += [body] * len(own)
                    hashes += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.string()), pa.array(sites, pa.string()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], ["place", "site", "page", "subtree"]
            )

    rows = pages.select("url", "html", F.xxhash64("html").alias("page")).mapInArrow(run, "place string, site string, page long, subtree long")
    return rows.withColumns({"place": F.xxhash64("place"), "site": F.xxhash64("site")})


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, shell_share: float = SHELL_SHARE) -> DataFrame:
    """site, subtree: what stands on at least min_pages different pages of a host or section and on min_share of them (shells: shell_share)."""
    hashes = subtree_hashes(pages).select("site", "page", "subtree").distinct()
    counted = stored(hashes.groupBy("site", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages), "subtrees")
    # Counted by the page's hash, of which there is one for each different page; only sites of enough pages matter.
    pages_of = pages.select("url", F.xxhash64("html").alias("page")).distinct()

    def sited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [(site, page) for url, page in zip(texts(b, "url"), b.column("page").to_pylist()) for site in sites_of(url)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([x for _, x in held], pa.int64())], ["site", "page"])

    total = pages_of.mapInArrow(sited, "site string, page long").select(F.xxhash64("site").alias("site"), "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    share = F.when(F.col("subtree").bitwiseAND(F.lit(1)) == 1, shell_share).otherwise(min_share)
    return counted.join(stored(total.where(F.col("pages") >= min_pages), "site_pages"), "site").where(F.col("n") >= share * F.col("pages")).select("site", "subtree")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast: int = MAX_BROADCAST, names: bool = True) -> DataFrame:
    """page_id, url, text of every page. Without names, only counted subtrees and elements that HTML never shows are taken out."""
    kind = pages.schema[id_col].dataType.simpleString()
    chosen = columns(pages, page_id=id_col, url=url_col, html=html_col)
    templates = site_templates(chosen)
    some = templates.limit(max_broadcast + 1).collect()
    schema = f"page_id {kind}, url string, text string"
    out = ["page_id", "url", "text"]

    def sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(sites_of, texts(b, "url")), pa.list_(pa.string()))], [*b.schema.names, "sites"])

    named = chosen.mapInArrow(sites, f"page_id {kind}, url string, html string, sites array<string>").withColumn("sites", F.transform("sites", lambda x: F.xxhash64(x)))
    if len(some) <= max_broadcast:
        by_site: dict[int, set[int]] = {}
        for r in some:
            by_site.setdefault(r["site"], set()).add(r["subtree"])
        shared = pages.sparkSession.sparkContext.broadcast(by_site)

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                said = [main_text(p, Either(*[shared.value.get(x, frozenset()) for x in held]), names) for held, p in zip(b.column("sites").to_pylist(), texts(b, "html"))]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(said, pa.string())], out)

        return named.mapInArrow(direct, schema)

    # Too many to broadcast: every page gets the recurring ones among its own hashes, by a join on site and hash.
    own = subtree_hashes(chosen).distinct().join(templates, ["site", "subtree"]).groupBy("place", "page").agg(F.collect_set("subtree").alias("recurring"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [main_text(p, set(r or ()), names) for r, p in zip(b.column("recurring").to_pylist(), texts(b, "html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(said, pa.string())], out)

    placed = named.withColumns({"page": F.xxhash64("html"), "place": F.element_at("sites", -1)})
    return placed.join(own, ["place", "page"], "left").select("page_id", "url", "html", "recurring").mapInArrow(joined, schema)
