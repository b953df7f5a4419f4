"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: nodes are paths of
elements with their classes. A node's importance is the larger of two
entropies: how much its inner layout differs from page to page, and how much
its text does. Branches whose nodes are all of low importance are the site's,
not the page's, and are removed. Elements whose markup says what they are (menus, adverts, the
article) carry that as their importance: menus may differ on every page, and
copied articles don't. Within an article that is marked, the style tree decides:
what is the same on the pages of a host goes, and words that may name a part of
an article as well as a part of the site only raise the importance it needs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.staging import stage
from .url_filter import host_of
from .words import bound_batches, unused_name

# Elements, roles and class or id words that say what a branch is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
NOISE_ELEMENTS = frozenset(
    "head title script style noscript template iframe object svg canvas nav header footer aside form menu dialog button "
    "select textarea input label fieldset audio video".split()
)
MAIN_ELEMENTS = frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
MAIN_ROLES = frozenset("main article".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pagination pager popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split()
)
#: Of these, words that may as well name a section of an article, where importance decides.
OPEN_WORDS = frozenset("banner header login masthead modal pager popup related replies reply respond share sharing signup social toolbar widget".split())
#: Even an article with one of these words is not the page's own.
OTHER_ARTICLES = frozenset("ad ads advert advertisement comment comments promo related reply sponsored".split())
#: Class names that begin so tell what a branch has, not what it is.
TELLS_OF = frozenset("has with without no".split())
_WORDS = re.compile(r"[a-z0-9]+")


def _named(given: dict) -> set[str]:
    """The words of an element's id and class names."""
    words: set[str] = set()
    for name in f"{given.get('class') or ''} {given.get('id') or ''}".lower().split():
        found = _WORDS.findall(name)
        if found and found[0] not in TELLS_OF:
            words.update(found)
    return words


@dataclass(frozen=True)
class TreeRule:
    """A node goes if it is on `pages` pages of its host at least and less important than `importance`."""

    pages: int = 5
    importance: float = 0.2
    open_importance: float = 0.6  # of a branch in an article whose name may mean part of the site


@dataclass
class Block:
    path: str
    role: str  # main, open (in an article, under a word that may mean part of the site), noise or empty
    text: str
    linked: bool  # all of it is the text of links

    @property
    def is_sentence(self) -> bool:
        return len(self.text.split()) >= 4 and self.text.rstrip("\"')”’»").endswith((".", "!", "?", "…", "。"))


@dataclass
class _Open:
    tag: str
    path: str
    role: str
    children: list[str] = field(default_factory=list)


class PageTree(HTMLParser):
    """The text blocks of one page, and the inner layout of each path."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.layouts: dict[str, str] = {}
        self.stack = [_Open("", "", "")]
        self.parts: list[str] = []
        self.unlinked = False

    @classmethod
    def of(cls, html: str | None) -> PageTree:
        tree = cls()
        if html:
            tree.feed(html)
            tree.close()
        while len(tree.stack) > 1:
            tree._pop()
        tree._end_block()
        return tree

    def _end_block(self) -> None:
        text, linked = " ".join("".join(self.parts).split()), not self.unlinked
        self.parts, self.unlinked = [], False
        if text:
            holder = next(node for node in reversed(self.stack) if node.tag not in INLINE)
            self.blocks.append(Block(holder.path, holder.role, text, linked))

    def _pop(self) -> None:
        node = self.stack[-1]
        if node.tag not in INLINE:
            self._end_block()
            self.layouts.setdefault(node.path, " ".join(node.children))
        self.stack.pop()

    def _close_to(self, tag: str, fences: frozenset | set) -> None:
        """End the innermost open `tag`, unless one of the fences is nearer."""
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                while len(self.stack) > at:
                    self._pop()
                return
            if self.stack[at].tag in fences:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_PARAGRAPH:
            self._close_to("p", {"td", "th", "table", "button"})
        if tag in CLOSES_ITSELF:
            self._close_to(tag, CLOSES_ITSELF[tag])
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag not in VOID:
                self.stack.append(_Open(tag, self.stack[-1].path, self._role(tag, dict(attrs))))
            return
        self._end_block()
        given = dict(attrs)
        parent = self.stack[-1]
        names = _WORDS.findall(f"{given.get('class') or ''} {given.get('id') or ''}".lower())
        label = ".".join([tag, *sorted({n for n in names if not n.isdigit()})])
        if not parent.children or parent.children[-1] != label:
            parent.children.append(label)  # repeated children are one style
        if tag not in VOID:
            self.stack.append(_Open(tag, f"{parent.path}/{label}", self._role(tag, given)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self._pop()

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
        elif tag in INLINE:
            self._close_to(tag, CLOSES_PARAGRAPH | {"li", "td", "th", "body"})
        elif tag not in VOID:
            self._close_to(tag, {"body"} if tag not in ("body", "html") else set())

    def handle_data(self, data):
        self.parts.append(data)
        if not self.unlinked and not any(node.tag == "a" for node in self.stack):
            self.unlinked = bool(data.strip())

    def _role(self, tag: str, given: dict) -> str:
        above = self.stack[-1].role
        if above == "noise":
            return above
        role = (given.get("role") or "").lower()
        if tag in NOISE_ELEMENTS or role in NOISE_ROLES:
            return "noise"
        if tag in ("html", "body"):
            return above
        named = _named(given)
        if tag in MAIN_ELEMENTS or role in MAIN_ROLES:
            return "noise" if named & OTHER_ARTICLES else "main"
        if above in ("main", "open") and not named & (NOISE_WORDS - OPEN_WORDS):
            return "open" if named & OPEN_WORDS else above
        return "noise" if named & NOISE_WORDS else above


def main_text(tree: PageTree, importance: Mapping[str, float], rule: TreeRule = TreeRule()) -> str:
    """The important blocks of the article; where none is marked, those outside of marked noise and unimportant nodes
    that are more than links.

    A branch has nothing left if all its nodes are unimportant, and keeps what is
    important in it. Nodes without an entry are either important or on too few
    pages to tell; they count as important, but for branches under a word that
    may mean part of the site, which have to be sentences then. Where most of a marked article is unimportant, the
    article itself is on many pages of its host; then all of it stays.
    """
    marked = [b for b in tree.blocks if b.role == "main" or b.role == "open" and not b.linked]
    if not marked:
        chosen = [b for b in tree.blocks if not b.role and not b.linked and importance.get(b.path, 1.0) >= rule.importance]
        return "\n".join(b.text for b in chosen)
    least = {"main": rule.importance, "open": rule.open_importance}
    chosen = [b for b in marked if importance.get(b.path, 1.0 if b.role == "main" or b.is_sentence else 0.0) >= least[b.role]]
    if 2 * sum(len(b.text) for b in chosen) < sum(len(b.text) for b in marked):
        chosen = [b for b in marked if b.role == "main"]
    return "\n".join(b.text for b in chosen)


def style_nodes(pages: DataFrame, rule: TreeRule = TreeRule()) -> DataFrame:
    """`host`, `path`, `pages`, `importance`, `holds_text` and `is_open` of each node on `rule.pages` pages of one host at least.

    Importance is 1 where every page differs and 0 where all agree. Counts are
    summed before they are shuffled, so a host with a third of all pages costs
    a row for each of its styles and task.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: Counter = Counter()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = PageTree.of(html)
                texts: dict[str, int] = {}
                opened = {block.path for block in tree.blocks if block.role == "open"}
                for block in tree.blocks:
                    if block.role != "noise":
                        texts[block.path] = zlib.crc32(block.text.encode(), texts.get(block.path, 0))
                for path, layout in tree.layouts.items():
                    counted[host, path, zlib.crc32(layout.encode()), False, path in opened] += 1
                for path, text in texts.items():
                    counted[host, path, text, True, path in opened] += 1
            rows = list(zip(*((*key, n) for key, n in counted.items()))) or [()] * 6
            types = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(rows, types)],
                names=["host", "path", "feature", "is_text", "is_open", "n"],
            )

    schema = "host string, path string, feature long, is_text boolean, is_open boolean, n long"
    counts = (
        pages.select(host_of(F.col("url")).alias("host"), "html")
        .mapInArrow(features, schema)
        .groupBy("host", "path", "feature", "is_text")
        .agg(F.sum("n").alias("n"), F.bool_or("is_open").alias("is_open"))
    )
    entropies = (
        counts.groupBy("host", "path", "is_text")
        .agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.bool_or("is_open").alias("is_open"))
        .filter(F.col("m") >= max(rule.pages, 2))
        .withColumn("entropy", F.lit(1.0) - F.col("s") / (F.col("m") * F.log("m")))
    )
    return entropies.groupBy("host", "path").agg(
        F.max("m").alias("pages"), F.max("entropy").alias("importance"), F.bool_or("is_text").alias("holds_text"), F.bool_or("is_open").alias("is_open")
    )


def distinct_pages(pages: DataFrame) -> DataFrame:
    """`url` and `html` of one page for each host and html, by hash and length; copies say nothing about a site's style."""
    hashed = pages.select("url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("which"), F.length("html").alias("size"))
    return hashed.dropDuplicates(["host", "which", "size"]).select("url", "html")


#: Hosts with unimportant branches up to this many are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 100_000


def extract_text(pages: DataFrame, rule: TreeRule = TreeRule()) -> DataFrame:
    """`pages` with `text`, the article of the whole html, its blocks joined by line breaks, and `n_chars`.

    Character references are decoded and white space within a block is one
    space. A null or empty html, or one without an article, has an empty text.
    Pages of a null url, or one without `://`, form the host of empty name.
    Repeated rows agree, and copies of a page count once in the entropies of its host. Columns of the two names are replaced, others stay.
    """
    bound_batches(pages.sparkSession)
    nodes = style_nodes(distinct_pages(pages), rule).filter("holds_text")
    # Important nodes of open branches have to be known, too, as only sentences count where nothing is known.
    low = nodes.filter((F.col("importance") < max(rule.importance, rule.open_importance)) | F.col("is_open"))
    low_name, host_name = (unused_name(pages.columns, name) for name in ("low", "host"))
    entries = F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias(low_name)
    named = stage(low.groupBy("host").agg(entries).withColumnRenamed("host", host_name), "unimportant")
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    few = named.count() <= BROADCAST_HOSTS
    sent = pages.select(*(f"`{c}`" for c in kept)).join(
        F.broadcast(named) if few else named, host_of(F.col("url")) == F.col(host_name), "left"
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in kept)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, low = batch.column("html").to_pylist(), batch.column(low_name).to_pylist()
            texts = [main_text(PageTree.of(page), dict(paths or ()), rule) for page, paths in zip(html, low)]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return sent.mapInArrow(extract, f"{fields}, text string, n_chars long")
