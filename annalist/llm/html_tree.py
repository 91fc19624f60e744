"""Main text of web pages by a site style tree.

The DOMs of one host are merged into one tree whose nodes are element paths (tag, classes, id). A node is important
if what it shows differs from page to page: content nodes by the entropy of their blocks over the pages, other
nodes by the entropy of their children (their presentation). Branches of low importance are removed from each
page, as are elements whose role says that they are no content. Only hashes of blocks are counted; a page's text
stays where it lies.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import prepare

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")

# Elements by their part in a document, and names that pages give to parts without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
NO_CONTENT = frozenset(
    "head nav header footer aside form script style noscript template iframe svg button select menu dialog object canvas "
    "textarea title option fieldset audio video map".split()
)
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation "
    "menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal newsletter subscribe "
    "signup share sharing social related recommended recommendations comments comment disqus replies responses widget "
    "pagination pager toolbar login search copyright legal disclaimer skip".split()
)
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table html body article section div main td th".split())


@dataclass
class Element:
    tag: str
    path: str
    removed: bool
    article: bool
    main: bool


@dataclass
class Page:
    """Blocks ``(path, text, in an article, in main)`` in page order, and the children of each element path."""

    blocks: list[tuple[str, str, bool, bool]] = field(default_factory=list)
    children: dict[str, list[str]] = field(default_factory=dict)

    def main_blocks(self) -> list[tuple[str, str, bool, bool]]:
        """Blocks of the articles, else of main, else all."""
        for level in (2, 3):
            if any(b[level] for b in self.blocks):
                return [b for b in self.blocks if b[level]]
        return self.blocks


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """The name of an element in the style tree, and whether its role or names say that it has no content."""
    if not attributes.strip(" /\n\t"):
        return tag, False
    found = {}
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        found.setdefault((hidden or name).lower(), a or b or c)
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = re.findall("[a-z]+", names)
    removed = (
        any(w in NO_CONTENT_NAMES for w in words) or found.get("role", "").lower() in NO_CONTENT_ROLES or "hidden" in found
        or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    )
    return ".".join([tag, *words]), removed


def parse(source: str | None, low: frozenset[str] | set[str] = frozenset()) -> Page:
    """Blocks of a page without those below removed elements or below paths in ``low``. Null gives no blocks."""
    page = Page()
    stack = [Element("", "", False, False, False)]
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                at = stack[-1]
                page.blocks.append((at.path, text, at.article, at.main))

    def close(tag: str, among: tuple[str, ...] | None = None, barrier: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in (among or (tag,)):
                flush()
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    source = source or ""
    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            if not stack[-1].removed:
                pieces.append(source[at:])
            break
        if m.start() > at and not stack[-1].removed:
            pieces.append(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not ending:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag in INLINE:
            # Inline elements make no node of the tree; a line break is white space.
            if tag == "br":
                pieces.append(" ") if not stack[-1].removed else None
            elif not ending and not stack[-1].removed and attributes and _label(tag, attributes)[1] and tag not in VOID:
                stack.append(Element(tag, stack[-1].path, True, stack[-1].article, stack[-1].main))
            elif ending and stack[-1].tag == tag:
                stack.pop()
            continue
        if ending:
            close(tag)
            continue
        if tag in CLOSES_P:
            close("p", None, SCOPES)
        if tag in ENDS:
            close(tag, ENDS[tag], SCOPES - set(ENDS[tag]))
        flush()
        parent = stack[-1]
        label, named = _label(tag, attributes)
        inside = parent.article or parent.main
        path = f"{parent.path}/{label}"
        removed = parent.removed or path in low or named and tag not in ("html", "body") or (tag in NO_CONTENT and not (tag == "header" and inside))
        if not parent.removed:
            page.children.setdefault(parent.path, []).append(label)
        if tag not in VOID and not attributes.endswith("/") or tag not in VOID and tag in SCOPES:
            role_main = tag == "main" or "role=\"main\"" in attributes
            stack.append(Element(tag, path, removed, parent.article or tag == "article" and not removed, parent.main or role_main and not removed))
    flush()
    return page


def main_text(source: str | None, low: frozenset[str] | set[str] = frozenset()) -> str:
    """The text of a page: its blocks, one per line."""
    return "\n".join(b[1] for b in parse(source, low).main_blocks())


STATISTICS = "host string, page long, kind int, node string, feature long"
_STATISTICS = pa.schema([("host", pa.string()), ("page", pa.int64()), ("kind", pa.int32()), ("node", pa.string()), ("feature", pa.int64())])
PAGE, PRESENTATION, CONTENT = 0, 1, 2


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def observations(source: str | None) -> list[tuple[int, int, str, int]]:
    """``(page, kind, node, feature)``: what one page adds to the tree of its host. Equal pages are one page."""
    page = parse(source)
    blocks = page.main_blocks()
    digest = _hash("\n".join(f"{b[0]}\t{b[1]}" for b in blocks))
    rows = {(digest, PAGE, "", 0)}
    rows |= {(digest, CONTENT, b[0], _hash(b[1])) for b in blocks}
    rows |= {(digest, PRESENTATION, node, _hash(" ".join(labels))) for node, labels in page.children.items()}
    return sorted(rows)


def style_tree(pages: DataFrame, host: str = "host", html: str = "html", min_pages: int = 5, damping: float = 0.9) -> DataFrame:
    """``(host, node, pages, importance)`` for all nodes of all hosts with at least ``min_pages`` different pages.

    A content node has 1 - the mean entropy of its blocks (0 for a block on one page, 1 for a block on all);
    a node's presentation is the entropy of its child lists. A branch is as important as its best node, the
    presentation of what only holds others being damped. Rows without a host join no tree.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                rows += [(place, *o) for o in observations(source)]
            columns = list(zip(*rows)) or [()] * len(_STATISTICS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STATISTICS)], schema=_STATISTICS)

    seen = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(run, STATISTICS)
    counts = seen.distinct().groupBy("host", "kind", "node", "feature").agg(F.count("*").alias("k"))
    sums = counts.groupBy("host", "kind", "node").agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.log(F.col("k").cast("double"))).alias("s")
    )
    sums = cut_lineage(sums)
    sites = sums.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages")).where(F.col("pages") >= min_pages)
    scale = F.log(F.greatest(F.col("pages").cast("double"), F.lit(2.0)))
    content = 1 - F.col("s") / F.col("n") / scale
    presentation = damping * (F.log(F.col("n").cast("double")) - F.col("s") / F.col("n")) / scale
    nodes = sums.where(F.col("kind") != PAGE).join(sites, "host").withColumn(
        "own", F.when(F.col("kind") == CONTENT, content).otherwise(presentation)
    )
    steps = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat_ws("/", F.slice(steps, F.lit(1), i)))
    return nodes.select("host", "pages", "own", F.explode(above).alias("node")).groupBy("host", "node").agg(
        F.max("pages").alias("pages"), F.max("own").alias("importance")
    )


def low_branches(tree: DataFrame, threshold: float = 0.2) -> DataFrame:
    """``(host, low)``: the paths to remove. Headings, paragraphs and the like inside an article are never removed."""
    last = F.regexp_extract("node", r"/([^/.]*)[^/]*$", 1)
    protected = F.col("node").rlike("/(article|main)(\\.|/|$)") & last.isin(*sorted(TEXT_TAGS))
    low = tree.where((F.col("importance") < threshold) & (F.col("node") != "") & ~protected & ~last.isin("html", "body", "article", "main", ""))
    return low.groupBy("host").agg(F.array_sort(F.collect_set("node")).alias("low"))


#: Characters of removed paths that may be sent to every task; more are joined by host.
BROADCAST_CHARS = 16_000_000


def extract(pages: DataFrame, url: str = "url", html: str = "html", threshold: float = 0.2, min_pages: int = 5) -> DataFrame:
    """All rows and columns with ``text`` (empty where there is none, also for null html) and ``n_chars``.

    Existing columns of these names are replaced. Pages without a host in their url are judged by roles alone.
    """
    prepare(pages.sparkSession)
    hosted = pages.withColumn("_host", F.lower(F.try_parse_url(F.col(url).cast("string"), F.lit("HOST"))))
    low = cut_lineage(low_branches(style_tree(hosted, "_host", html, min_pages), threshold)).withColumnRenamed("host", "_host")
    size = low.agg(F.sum(F.length(F.concat_ws("", "low")) + F.length("_host"))).first()[0] or 0

    @F.pandas_udf("string")
    def text(sources: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, frozenset(() if p is None else p)) for s, p in zip(sources, paths)], dtype=object)

    joined = hosted.join(F.broadcast(low) if size <= BROADCAST_CHARS else low, "_host", "left")
    done = joined.withColumn("text", text(F.col(html), "low")).withColumn("n_chars", F.length("text").cast("long"))
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    return done.select(*keep, "text", "n_chars")
