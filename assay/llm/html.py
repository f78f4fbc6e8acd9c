"""HTML extraction with consensus host paths (operator 4).

First pass: every page is cut into containers, each container that directly holds blocks of text is scored, and the page
votes for its best one's generalised path (tag and class names without digits, from the root). Votes are summed per
host and path in Spark; a host's winning paths, its top one and all that at least ``LEAST_SHARE`` of its pages voted for,
go back to its pages. Second pass: the main text is taken from the containers on the page's own best path if that is
one of the winners, else on the first winner that the page has, else, where it has none, on its own best path.

Blocks inside menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles never
count and are never taken, wherever they stand. Elements tell so by tag, role or name; a name does if all its parts are
boilerplate's or say nothing (``related-posts``, not ``related-work``). The header element of an article is the
article's own: it holds its headline. Elements that are hidden from readers are no text of the article.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.shared import cut, table, text_batches

#: Up to this many hosts the winners are broadcast (at most some 20 MB of paths); beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Share of a host's votes from which a path is one of its winners.
LEAST_SHARE = 0.05
#: A longer path is replaced by its digest, which its descendants' paths go on from.
MAX_PATH = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form button dialog menu head".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th tbody thead tfoot".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?:$|[\s_-])", re.I)
#: Words that name boilerplate, and words that may stand beside them in a name without changing it.
BOILERPLATE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs captcha comment comments commenting cookie cookies consent disclaimer disqus footer gdpr masthead menu
    menus modal nav navbar navigation newsletter notice notices notification notifications pagination pager paywall popup promo promos promotion promoted recommended recommendation recommendations related replies
    reply respond responses share sharing sidebar sidebars skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets alert alerts login signup signin""".split()
)
NEUTRAL_NAMES = frozenset(
    """site page main top bottom left right box boxes bar block blocks list lists item items wrapper wrap container containers section area inner outer link links button buttons icon icons form panel content text
    body post posts article articles story stories slot unit placement policy message overlay row column columns group holder region module global primary secondary fixed sticky floating mobile desktop thread count
    meta title heading author field input media header user reader readers up out the to of and us my js is has""".split()
)
HEADER_NAMES = frozenset("header site-header page-header global-header top-header main-header site_header page_header siteheader pageheader search search-box search-form searchform searchbox search-bar".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _boilerplate_name(name: str, within: bool) -> bool:
    """Whether a class or id names boilerplate; page headers and search boxes are looked for outside articles only."""
    if not within and name.lower() in HEADER_NAMES:
        return True
    parts = [x for x in _PARTS.split(_DIGITS.sub("", _CAMEL.sub("-", name)).lower()) if x]
    return not BOILERPLATE_NAMES.isdisjoint(parts) and all(x in BOILERPLATE_NAMES or x in NEUTRAL_NAMES for x in parts)


def _element(tag: str, raw: str, within: bool = False) -> tuple[str, bool, bool]:
    """Generalised step of an element's path; whether it is boilerplate; whether it calls itself an article.

    within: whether it lies in an element that calls itself an article, whose own header belongs to it.
    """
    by_tag = tag in BOILERPLATE_TAGS and not (within and tag == "header")
    if not raw or "=" not in raw and "hidden" not in raw:
        return tag, by_tag, tag in ARTICLE_TAGS
    attrs = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    role = attrs.get("role", "").lower()
    style = attrs.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    good = tag in ARTICLE_TAGS or role in ("main", "article") or attrs.get("itemprop") == "articleBody"
    named = bool(names) and not good and tag not in ("html", "body") and any(_boilerplate_name(x, within) for x in names.split())
    bad = by_tag or role in BOILERPLATE_ROLES or hidden or named
    classes = ".".join(sorted({_DIGITS.sub("", c) for c in attrs.get("class", "").split()} - {""}))
    return (f"{tag}.{classes}" if classes else tag), bad, good or bool(names and ARTICLE_NAMES.search(names))


class Container:
    __slots__ = ("blocks", "good", "letters", "linked", "parent", "path", "whole", "within")

    def __init__(self, path: str, good: bool, parent: int = -1, whole: bool = False, within: bool = False):
        self.path, self.good, self.parent, self.whole, self.within, self.letters, self.linked, self.blocks = path, good, parent, whole, within or whole, 0, 0, 0


def parse(page: str | None) -> tuple[list[Container], list[tuple[int, str]]]:
    """The containers of a page and its blocks of text in page order, each with its container's index.

    A block is the text between two block-level limits, white space turned into single spaces. Unclosed paragraphs,
    items and cells end where HTML ends them; stray end tags are ignored; unclosed elements end with the page.
    """
    containers = [Container("", False)]
    blocks: list[tuple[int, str]] = []
    # (tag, container index, boilerplate depth before it, link depth before it)
    stack: list[tuple[str, int, int, int]] = []
    inside, bad, links = 0, 0, 0
    buffer: list[str] = []
    linked = 0
    text = page or ""

    def end_block() -> None:
        nonlocal linked
        if buffer:
            joined = _SPACE.sub(" ", "".join(buffer)).strip()
            if joined:
                c = containers[inside]
                c.letters += len(joined)
                c.linked += linked
                c.blocks += 1
                blocks.append((inside, joined))
            buffer.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal inside, bad, links
        while len(stack) > to:
            tag, inside_, bad_, links_ = stack.pop()
            if tag not in INLINE:
                end_block()
            inside, bad, links = inside_, bad_, links_

    def words(raw: str) -> None:
        nonlocal linked
        if not bad and raw:
            t = entities.unescape(raw) if "&" in raw else raw
            buffer.append(t)
            if links:
                linked += len(t.strip())

    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if not m:
            words(text[at:])
            break
        if m.start() > at:
            words(text[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                words(m[1].replace("&", "&amp;"))
            continue
        tag = m[3].lower()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if stack[i][0] in ("article", "body", "html", "table", "main", "section") and tag in INLINE:
                    break
            continue
        closed = m[4].endswith("/")
        if tag in RAW and not closed:  # its content is no markup
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at) if tag in ("script", "style", "textarea", "title", "noscript", "iframe") else None
            if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):
                at = close.end() if close else n
                continue
        if tag == "br":
            words("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME[tag]:
                    pop(i)
                    break
                if stack[i][0] in SCOPES[tag]:
                    break
        if closed and tag in INLINE:
            continue
        if tag not in INLINE:
            end_block()
        stack.append((tag, inside, bad, links))
        if tag == "a":
            links += 1
        if tag in INLINE:
            if m[4] and _element(tag, m[4], containers[inside].within)[1]:
                bad += 1
            continue
        step, is_bad, good = _element(tag, m[4], containers[inside].within)
        if is_bad:
            bad += 1
        elif not bad and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "dt", "dd", "pre", "blockquote", "ul", "ol", "table", "tbody", "dl", "figure"):
            path = f"{containers[inside].path}/{step}"
            if len(path) > MAX_PATH:
                path = "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            containers.append(Container(path, good, inside, good and tag not in ("html", "body"), containers[inside].within))
            inside = len(containers) - 1
    pop(0)
    end_block()
    return containers, blocks


def score(c: Container) -> float:
    """Points of a container: its own text outside links, doubled where it calls itself an article."""
    return max(0.0, (c.letters - 2 * c.linked)) * (2.0 if c.good else 1.0) * (1.0 + 0.1 * min(c.blocks, 20))


def best_path(containers: list[Container]) -> tuple[str, float]:
    """The path with most points over the page's containers, and these; ("", 0.0) if no container has text.

    An article may be spread over several containers: the path is that of the outermost element around the best one
    that calls itself an article (html and body aside), if there is any.
    """
    points: dict[str, float] = {}
    for c in containers:
        points[c.path] = points.get(c.path, 0.0) + score(c)
    path = max(points, key=lambda p: (points[p], p))
    at = max((i for i, c in enumerate(containers) if c.path == path), key=lambda i: score(containers[i]))
    best = path
    while at >= 0:
        if containers[at].whole:
            best = containers[at].path
        at = containers[at].parent
    return best, points[path]


def extract(page: str | None, winners: list[str] | None) -> str:
    """The main text: blocks of the containers on the chosen path or below it.

    winners: the host's winning paths, most votes first. The page's own best path is chosen if it is one of them, else
    the first of them that has text here, else the page's own.
    """
    containers, blocks = parse(page)
    if not blocks:
        return ""

    def take(path: str) -> str:
        below: list[bool] = []
        for c in containers:  # parents come first
            below.append(c.path == path or c.parent >= 0 and below[c.parent])
        return " ".join(t for i, t in blocks if below[i])

    own, here = best_path(containers)[0], {c.path for c in containers}
    for path in [own] if not winners or own in winners else winners:
        if path in here:
            found = take(path)
            if found:
                return found
    return take(own)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port; the empty text for a null URL or one without a host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, paths): per host the path with most votes, ties to the one that sorts last, and all others with at
    least ``LEAST_SHARE`` of its votes (so at most 1 / LEAST_SHARE), most votes first.

    Every page's vote counts one, so no long page outweighs others; votes are partially summed before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                found = [best_path(parse(h)[0]) for h in part.column(1).to_pylist()]
                votes = [(h, p) for h, (p, s) in zip(part.column(0).to_pylist(), found, strict=True) if s > 0]
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in votes], pa.string()) for i in (0, 1)], ["host", "path"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path string")
    votes = cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")), "host-votes")
    hosts = votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("top"), F.sum("votes").alias("total"))
    some = votes.join(hosts, "host").where((F.col("path") == F.col("top.path")) | (F.col("votes") >= F.col("total") * LEAST_SHARE))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("votes", "path"))))
    return some.groupBy("host").agg(F.transform(ordered, lambda v: v["path"]).alias("paths"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text) for every page; null and empty pages give the empty text.

    Pages without a host vote together under the empty host. Pages of any length are parsed whole, in linear time.
    """
    winners = cut(host_paths(pages, url_col, html_col), "host-paths")
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"))
    few = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = rows.join(F.broadcast(winners) if few else winners, "host", "left").select("id", "html", "url", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                texts = [extract(h, p) for h, p in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = dict(pages.dtypes)[id_col]
    return rows.mapInArrow(run, f"id {kind}, url string, text string")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
