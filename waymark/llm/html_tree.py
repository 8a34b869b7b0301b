"""Main text of web pages by a site style tree.

Pages of one host are parsed and merged: elements on the same path (tag,
class and id from the body down) are one node of the host's tree. A node is
judged by what its pages put there:

* presentation: how differently they lay it out (entropy of the child tags);
* content: how little its texts repeat from page to page (one minus the
  entropy of each text over the pages, averaged);
* role: what the element says it is. Menus, footers, adverts and the like
  weigh a tenth, an article counts twice. A class or id counts only as a whole,
  and not if the element holds most of what the page is about: most text of its
  articles, or of the page if it has none.

Pages of a host with the same blocks, but for menus, adverts and the like,
are copies and count as one page.

Branches of low importance are cut from every page of the host, the texts of
what is left are the page's text. The tree is a table of counts, added up per
task before the shuffle, so a host with a third of all pages is no problem.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import materialize, only

THRESHOLD = 0.25
CONTENT_SHARE = 0.9
BROADCAST_CHARS = 16_000_000  # cut paths sent to all tasks at most; more are joined by host
MIN_PAGES = 3  # on fewer pages of a host, repetition says nothing

# Elements that start a new block, never hold text of their own, or have no end tag.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " tr ul".split()
)
SKIP = frozenset(
    "script style noscript template title head select option textarea button iframe object svg math canvas audio video"
    " map datalist".split()
)
# What can stand in a head; anything else ends one that was left open.
HEAD = frozenset("html head title style script noscript noframes template base basefont bgsound link meta".split())
HEAD_HIDDEN = frozenset("title style script noscript noframes template".split())
# Elements of other languages: a slash closes them, and a block of the page ends them.
FOREIGN = frozenset("svg math".split())
FOREIGN_TEXT = frozenset("foreignobject desc title annotation-xml".split())
# Controls hold no such blocks: one that starts in them shows that they were left open.
CONTROLS = frozenset("button select option datalist".split())
PAGE_BLOCK = frozenset(
    "address article aside blockquote body dl figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LIST_BOUNDS = frozenset("ul ol dl table article section div nav menu".split())

# Roles of elements by tag, and by their class or id. Forms and dialogs may wrap a whole page.
AWAY_TAGS = "nav|footer|aside|menu"
AWAY_WRAPS = frozenset("form dialog fieldset".split())
AWAY_WORDS = frozenset((
    "ad|ads|advert|advertisement|adsense|banner|sponsor|sponsored|promo|promotion|menu|nav|navbar|navigation|breadcrumb|"
    "breadcrumbs|sidebar|side|footer|header|masthead|topbar|cookie|cookies|consent|gdpr|notice|notices|notification|popup|"
    "modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|"
    "recommendations|widget|toolbar|pagination|pager|comment|comments|reply|replies|respond|disqus|feedback|copyright|"
    "legal|disclaimer|skip|rating|tags|toc"
).split("|"))
# What may stand beside such a word in a class: left-sidebar, social-links; not has-sidebar.
BESIDE = frozenset(
    "site main page global primary secondary top bottom left right container wrapper wrap box bar list links link item items"
    " inner outer area block section button buttons icon icons".split()
)
MAIN = "article|main"
_AWAY_PATH = rf"!(/|$)|(^|/)({AWAY_TAGS})\."
_AWAY = re.compile(_AWAY_PATH)
_END_TAG = re.compile(r"</([a-z]+)")
_NAME = re.compile(r"[^a-z_-]+")


def _says_away(role: str) -> bool:
    """Whether a class, id or role as a whole is that of a menu, an advert or the like."""
    for name in role.split():
        parts = [part for part in re.split("[_-]+", name) if part and not part.isdigit()]
        if any(part in AWAY_WORDS for part in parts) and all(part in AWAY_WORDS or part in BESIDE for part in parts):
            return True
    return False


class _Element:
    __slots__ = ("away", "name", "tag")

    def __init__(self, tag: str, words: str, away: bool):
        self.tag, self.name, self.away = tag, f"{tag}.{words}", away


def _path(elements: tuple[_Element, ...]) -> str:
    return "/".join(element.name + ("!" if element.away else "") for element in elements)


class _Page(HTMLParser):
    """The blocks of text of a page with their element paths, and the child
    tags of every element."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        # How many end tags of skipped elements are still to come.
        self._ends = Counter(_END_TAG.findall(html.lower()))
        self.blocks: list[tuple[tuple[_Element, ...], str]] = []
        self.shapes: list[tuple[tuple[_Element, ...], str]] = []
        self._open: list[_Element] = []
        self._tags: list[list[str]] = [[]]
        self._skip: list[str] = []
        self._text: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((tuple(self._open), text))
        self._text = []

    def _close(self, keep: int) -> None:
        """Close elements until so many are open."""
        if len(self._open) > keep:
            self._flush()
        while len(self._open) > keep:
            self.shapes.append((tuple(self._open), " ".join(self._tags.pop())))
            self._open.pop()

    def _left_open(self, tag: str) -> bool:
        """Whether a start tag shows that the skipped element before it was never closed."""
        if self._skip[0] in FOREIGN:
            return tag in BLOCK and not any(inner in FOREIGN_TEXT for inner in self._skip)
        return self._skip[0] in CONTROLS and tag in PAGE_BLOCK and not any(inner in BLOCK for inner in self._skip)

    def handle_starttag(self, tag, attrs, closed=False):
        if self._skip[:1] == ["head"] and (tag == "body" or len(self._skip) == 1 and tag not in HEAD):
            self._skip.clear()
        if self._skip and self._left_open(tag):
            self._skip.clear()
        if self._skip:
            if not closed and tag not in VOID and (self._skip != ["head"] or tag in HEAD_HIDDEN):
                self._skip.append(tag)
            return
        if tag in SKIP:
            if tag != "head":
                self._note(tag)
            # Of others the slash means nothing, but then an end tag is to come.
            if not closed or tag not in FOREIGN and self._ends[tag]:
                self._skip.append(tag)
            return
        self._note(tag)
        role = " ".join(value or "" for name, value in attrs if name in ("class", "id", "role")).lower()
        away = tag in AWAY_WRAPS or _says_away(role)
        if tag in VOID:
            self._text.append(" ")
            if tag == "hr":
                self._flush()
            return
        if tag not in BLOCK and not away:
            return
        self._flush()
        if tag in ("html", "body"):
            return
        if tag in ENDS:
            for at in reversed(range(len(self._open))):
                if self._open[at].tag in ENDS[tag]:
                    self._close(at)
                elif self._open[at].tag in LIST_BOUNDS:
                    break
        elif tag in BLOCK and self._open and self._open[-1].tag == "p":
            self._close(len(self._open) - 1)
        words = ".".join(sorted(set(_NAME.sub(" ", role).split())))
        self._open.append(_Element(tag, words, away))
        self._tags.append([])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        self._ends[tag] -= 1
        if self._skip:
            if tag in self._skip:
                while self._skip.pop() != tag:
                    pass
                return
            if not any(element.tag == tag for element in self._open):
                return
            self._skip.clear()  # its parent ends here
        for at in reversed(range(len(self._open))):
            if self._open[at].tag == tag:
                self._close(at)
                return
        if tag in BLOCK:
            self._flush()

    def handle_data(self, data):
        if self._skip == ["head"] and data.strip():
            self._skip.clear()
        if not self._skip:
            self._text.append(data)

    def _note(self, tag: str) -> None:
        if not self._tags[-1] or self._tags[-1][-1] != tag:  # runs of one tag count as one
            self._tags[-1].append(tag)

    def finish(self) -> None:
        self.close()
        self._close(0)
        self._flush()
        self._keep_main()

    def _keep_main(self) -> None:
        """Elements that hold most of what the page is about are not away,
        whatever they say: most text of its articles, of those that say they
        are something else if there are no others, or of the whole page."""
        if not any(element.away for elements, _ in self.blocks for element in elements):
            return
        tags, main = AWAY_TAGS.split("|"), MAIN.split("|")

        def article(elements: tuple[_Element, ...], away: bool) -> bool:
            return any(e.tag in main and (away or not e.away) for e in elements) and not any(e.tag in tags for e in elements)

        for counts in (lambda e: article(e, False), lambda e: article(e, True), lambda e: True):
            about = [(elements, len(text)) for elements, text in self.blocks if counts(elements)]
            if about:
                break
        held: dict[_Element, int] = {}
        for elements, chars in about:
            for element in elements:
                held[element] = held.get(element, 0) + chars
        total = sum(chars for _, chars in about)
        for element, chars in held.items():
            if 2 * chars > total:
                element.away = False


def parse(html: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(path, text) of the blocks and (path, child tags) of the elements.
    Whatever is left open at the end is closed there."""
    page = _Page(html)
    page.feed(html)
    page.finish()
    return [(_path(elements), text) for elements, text in page.blocks], [(_path(elements), tags) for elements, tags in page.shapes]


def _digest(blocks: list[tuple[str, str]]) -> int:
    digest = blake2b(digest_size=8)
    for path, text in blocks:
        if not _AWAY.search(path):
            digest.update(f"{path}\0{text}\0".encode("utf-8", "surrogatepass"))
    return int.from_bytes(digest.digest(), "little", signed=True)


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, host, blocks, shapes, copy of every row; a NULL page is
    empty. Pages with the same blocks, away ones aside, have the same `copy`."""
    schema = (
        "page_id long, url string, blocks array<struct<path:string,text:string>>, "
        "shapes array<struct<path:string,tags:string>>, copy long"
    )
    blocks_type = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
    shapes_type = pa.list_(pa.struct([("path", pa.string()), ("tags", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(body.as_py() or "") for body in batch.column(2)]
            blocks = [[{"path": path, "text": text} for path, text in blocks] for blocks, _ in found]
            shapes = [[{"path": path, "tags": tags} for path, tags in dict.fromkeys(shapes)] for _, shapes in found]
            copies = [_digest(blocks) for blocks, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(blocks, blocks_type),
                    pa.array(shapes, shapes_type),
                    pa.array(copies, pa.int64()),
                ],
                names=["page_id", "url", "blocks", "shapes", "copy"],
            )

    rows = only(pages, page_id=page_id, url=url, html=html).select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), "html"
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return rows.mapInArrow(read, schema).withColumn("host", host)


def _role(path: Column) -> Column:
    """What the element's own words say: a tenth, twice, or nothing."""
    inside = path.rlike(rf"(^|/)({MAIN})[./!]") | path.rlike(rf"(^|/)({MAIN})\.[^/]*$")
    away = path.rlike(_AWAY_PATH) | (path.rlike(r"(^|/)header\.") & ~inside)
    return F.when(away, 0.1).when(inside, 2.0).otherwise(1.0)


def importance(read: DataFrame) -> DataFrame:
    """host, path, pages, presentation, content, importance of every node of
    the style trees. One row per host and distinct element path. `pages` and
    the entropies count each text and layout once per distinct page."""
    texts = read.select("host", "copy", F.explode("blocks").alias("b")).groupBy(
        "host", F.col("b.path").alias("path"), F.xxhash64("b.text").alias("feature")
    )
    leaf = (
        texts.agg(F.count_distinct("copy").alias("n"))
        .groupBy("host", "path")
        .agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.log("n")).alias("spread"))
    )
    shapes = read.select("host", "copy", F.explode("shapes").alias("s")).groupBy(
        "host", F.col("s.path").alias("path"), F.xxhash64("s.tags").alias("shape")
    )
    node = (
        shapes.agg(F.count_distinct("copy").alias("n"))
        .groupBy("host", "path")
        .agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("alike"))
    )
    # The texts of a branch are those of all paths below it.
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    branch = (
        leaf.select("host", F.explode(prefixes).alias("path"), "texts", "spread")
        .groupBy("host", "path")
        .agg(F.sum("texts").alias("texts"), F.sum("spread").alias("spread"))
    )
    base = F.log(F.col("pages").cast("double"))
    few = F.col("pages") < MIN_PAGES
    presentation = F.when(few, 1.0).otherwise(1 - F.col("alike") / (F.col("pages") * base))
    content = F.when(few, 1.0).otherwise(F.greatest(1 - F.col("spread") / (F.col("texts") * base), F.lit(0.0)))
    return (
        branch.join(node, ["host", "path"])
        .select("host", "path", "pages", presentation.alias("presentation"), content.alias("content"))
        .withColumn(
            "importance",
            _role(F.col("path"))
            * ((1 - CONTENT_SHARE) * F.col("presentation") + CONTENT_SHARE * F.col("content")),
        )
    )


def extract(
    pages: DataFrame,
    threshold: float = THRESHOLD,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`.

    Pages are parsed once, whole; a NULL page has the empty text. Pages
    without a host share one tree. Repeated rows stay rows of their own, an
    empty table gives no rows, other columns are ignored. Within an article
    nothing is cut but what says itself that it is something else.
    """
    read = materialize(parsed(pages, page_id, url, html), "pages-parsed")
    cut = (
        importance(read)
        .where(F.col("importance") < threshold)
        .groupBy("host")
        # As many paths as the site has different layouts.
        .agg(F.collect_set("path").alias("cut"))
    )
    # The pages need not move if the list of all cut paths is small, which is checked.
    cut = materialize(cut, "pages-cut")
    chars = F.length("host") + F.aggregate("cut", F.lit(0), lambda total, path: total + F.length(path) + 16)
    size = cut.agg(F.coalesce(F.sum(chars), F.lit(0))).first()[0]
    if size <= BROADCAST_CHARS:
        cut = F.broadcast(cut)

    def kept(block):
        return ~F.exists(F.col("cut"), lambda path: (block["path"] == path) | block["path"].startswith(F.concat(path, F.lit("/"))))

    blocks = F.when(F.col("cut").isNull(), F.col("blocks")).otherwise(F.filter("blocks", kept))
    text = F.array_join(F.transform(blocks, lambda block: block["text"]), "\n")
    return (
        read.select("page_id", "url", "host", "blocks")
        .join(cut, "host", "left")
        .select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
