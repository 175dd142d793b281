"""Main text of web pages by site style trees.

Pages of a host are merged by the paths of their elements, written as tags with classes. Of each path the tree holds in
how many pages it stands, how its children vary and how its texts vary. Both variations are entropies: a branch that
looks and reads alike on many pages is template, a branch that differs from page to page is content. Branches of low
importance are removed from each page, as are those whose tag, class or role says what they are.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_below, carried, own, packed, stored, unpacked

# Fewer pages of a host tell nothing about a path.
LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.3
# Weight of a node's own presentation against its content falls with this power of its child count.
DECAY = 0.9
# A node's texts are those at most this many nested elements below it; a node with deeper text is not judged as a whole.
LEVELS = 16

# Fixed HTML vocabulary.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea select svg iframe annotation annotation-xml title head".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
NOISE_TAGS = set("nav footer aside form button menu dialog".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOISE_WORDS = set(
    "ad ads adbox advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice alert popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb"
    " breadcrumbs pagination pager sidebar widget widgets related recommended share sharing social footer masthead"
    " topbar toolbar copyright legal skip search comment comments reply replies respond disqus".split()
)
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
# What names of chrome are made of beside its words: "comments-area", "related-posts".
COMPANION_WORDS = set(
    "area bar bottom box button buttons container content form global inner item items left link links list main media"
    " page pages post posts primary right secondary section site slot thread title top unit widget wrap wrapper".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements of a head; anything else, text as well, ends one that is not closed.
HEAD = set("base basefont bgsound head html link meta noscript script style template title".split())
# A start of the first kind ends an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _raw_end(page: str, tag: str, at: int) -> int:
    """Place after the end tag of an element without markup that is open at ``at``, or the page's end."""
    stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return stop.end() if stop else len(page)


def _head_end(page: str, at: int) -> int:
    """Place at which a head that is open at ``at`` ends: after its end tag, or before what cannot stand in it."""
    while m := TOKEN.search(page, at):
        if page[at : m.start()].strip():
            return at
        closing, tag = (m[1], m[2]) if m[2] else (m[4], m[5])
        tag = (tag or "").lower()
        if closing and tag == "head":
            return m.end()
        if tag and not closing and tag not in HEAD:
            return m.start()
        at = m.end()
        if tag in RAW and tag != "head" and not closing:
            past = _raw_end(page, tag, at)
            if tag == "title" or past == len(page):  # one that is not closed ends with the head
                early = re.compile(r"(?=</head\b|<body\b)", re.I).search(page, at, past)
                past = early.start() if early else past
            at = past
    return at


def _mark(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 | zlib.crc32(raw[::-1]) >> 1


def _named(names: str, chrome: set[str]) -> bool:
    """One of the names is made of words of ``chrome`` and their companions, so "related-work" is no "related-posts"."""
    for name in names.split():
        words = {w.lower() for w in WORD.findall(name)}
        if words & chrome and words <= NOISE_WORDS | COMPANION_WORDS:
            return True
    return False


def _hinted(tag: str, values: dict[str, str], main: bool) -> bool:
    """Tag, role or name say that an element is no part of an article.

    Names of headings and sections are often made from the heading's words. Inside the main part headings are never
    hinted by name, and the id of a section tells only comments.
    """
    if tag in ("html", "body", "main"):
        return False
    classes, name = values.get("class", ""), values.get("id", "")
    if tag == "article":
        return _named(classes, COMMENT_WORDS) or _named(name, COMMENT_WORDS)
    if tag in NOISE_TAGS or values.get("role", "").lower() in NOISE_ROLES or "hidden" in values:
        return True
    if tag in HEADINGS:
        return not main and _named(classes, NOISE_WORDS)
    by_id = _named(name, COMMENT_WORDS if tag == "section" and main else NOISE_WORDS)
    if main:
        return by_id or _named(classes, NOISE_WORDS)
    words = {w.lower() for w in WORD.findall(classes)}
    return by_id or bool(words & NOISE_WORDS) or tag == "header" or "header" in words or _named(name, {"header"})


class _Page:
    """One pass over a page: its blocks of text with their nodes, and what each path holds.

    Nodes are the block elements in page order, each with its path's mark and its parent's number; node 0 is the page.
    A path's mark is made from its parent's, so the work is in proportion to the page at any depth.
    """

    def __init__(self) -> None:
        self.blocks: list[tuple[str, bool, int]] = []
        self.children: dict[int, list[str]] = {}
        self.paths: list[int] = [0]
        self.parents: list[int] = [-1]
        self.around: set[int] = {0}
        self.plain: set[int] = set()
        # (tag, node, noise, in the main part)
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.places: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.parts: list[str] = []
        self.has_main = False

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.parts = []
        _, node, noise, main = self.stack[-1]
        if text and not noise:
            self.blocks.append((text, main, node))

    def last(self, tags: set[str]) -> int:
        """Place of the innermost open element of ``tags``; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.open_blocks.pop()

    def open(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
            if self.open_blocks and self.stack[self.open_blocks[-1]][0] == "p":
                self.cut(self.open_blocks[-1])
            if tag in ENDS:
                stop = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot"} | ({"tr"} if tag in ("td", "th") else set())
                ended = self.last(ENDS[tag])
                if ended > self.last(stop):
                    self.cut(ended)
        values: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), html.unescape(value.strip("\"'")))
        _, node, noise, main = self.stack[-1]
        noise = noise or _hinted(tag, values, main)
        opens_main = not noise and (tag in ("article", "main") or values.get("role", "").lower() == "main")
        if opens_main:
            main = self.has_main = True
            above = node
            while above not in self.around:
                self.around.add(above)
                self.plain.add(self.paths[above])
                above = self.parents[above]
        if block:
            words = {w.lower() for w in WORD.findall(values.get("class", "") + " " + values.get("id", ""))}
            name = tag + "".join("." + re.sub(r"\d+", "0", w) for w in sorted(words))
            parent = self.paths[node]
            self.children.setdefault(parent, []).append(name)
            self.parents.append(node)
            self.paths.append(_mark(f"{parent}/{name}"))
            node = len(self.paths) - 1
            if tag in ("html", "body", "main", "article") or main and not words:
                self.plain.add(self.paths[node])
        place = len(self.stack)
        self.stack.append((tag, node, noise, main))
        self.places.setdefault(tag, []).append(place)
        if block:
            self.open_blocks.append(place)

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        place = self.last({tag})
        if place and (tag in BLOCKS or not self.open_blocks or place > self.open_blocks[-1]):
            self.cut(place)

    def read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            if m is None:
                self.parts.append(page[at:])
                break
            self.parts.append(page[at : m.start()])
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self.close(tag)
            elif tag in VOID:
                if tag == "hr":
                    self.flush()
                self.parts.append(" ")
            elif tag in RAW:
                at = _head_end(page, at) if tag == "head" else _raw_end(page, tag, at)
                self.parts.append(" ")
            else:
                self.open(tag, attributes or "")
        self.flush()


def parse(page: str | None) -> tuple[list, list, list, list]:
    """(blocks, nodes, paths, parents) of one page.

    Blocks are (text, number of the node they stand in); ``paths`` and ``parents`` give the path mark and the parent's
    number of each node with text, parents first, -1 at the top. Nodes, one of each path that may be removed, are (path
    mark, presentation, child kinds, marks of the texts below). Text outside the article or main part counts only where
    a page has neither. The main part, what it stands in, nodes without a class or id inside it, and nodes with text
    more than ``LEVELS`` below hold their text and are no candidates for removal.
    """
    reader = _Page()
    reader.read(page or "")
    kept = [(t, node) for t, main, node in reader.blocks if main or not reader.has_main]
    used: set[int] = {0}
    for _, node in kept:
        while node not in used:
            used.add(node)
            node = reader.parents[node]
    order = sorted(used - {0})
    height = dict.fromkeys(used, 0)
    plain = set(reader.plain)
    for node in reversed(order):
        above = reader.parents[node]
        height[above] = max(height[above], height[node] + 1)
        if height[node] >= LEVELS:
            plain.add(reader.paths[node])
    texts: dict[int, list[int]] = {reader.paths[n]: [] for n in order if reader.paths[n] not in plain}
    for text, node in kept:
        text_mark = _mark(text)
        for _ in range(LEVELS):
            if node <= 0:
                break
            if reader.paths[node] in texts:
                texts[reader.paths[node]].append(text_mark)
            node = reader.parents[node]
    nodes = []
    for mark in sorted(texts):
        kinds = reader.children.get(mark, [])
        collapsed = [k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k]
        nodes.append((mark, _mark(",".join(kinds)), len(collapsed), sorted(set(texts[mark]))))
    number = {n: i for i, n in enumerate(order)}
    blocks = [(t, number.get(node, -1)) for t, node in kept]
    return blocks, nodes, [reader.paths[n] for n in order], [number.get(reader.parents[n], -1) for n in order]


def left_over(blocks: list, paths: list, parents: list, removed: list) -> str:
    """Texts of the blocks of a page that stand in no node with a path of ``removed``, joined."""
    low = set(removed)
    gone: list[bool] = []
    for path, above in zip(paths, parents):
        gone.append(path in low or (above >= 0 and gone[above]))
    return "\n\n".join(b["text"] for b in blocks if b["node"] < 0 or not gone[b["node"]])


PARSED = (
    "blocks array<struct<text: string, node: int>>, paths array<bigint>, parents array<int>, place bigint,"
    " nodes array<struct<path: bigint, style: bigint, kinds: int, texts: array<bigint>>>"
)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of ``nodes`` (host, path, style, kinds, texts), one row per page and path.

    Presentation: entropy of the children's arrangement over the pages, to the base of their number. Content: one less
    the mean, over texts, of the entropy of a text's pages. Where a node has more kinds of children, presentation
    weighs more. A single page has importance 1. All counts are combined by each task before they are exchanged, so a
    host with many pages is spread.
    """
    styles = nodes.groupBy("host", "path", "style").agg(F.count("*").alias("c"), F.max("kinds").alias("kinds"))
    shown = styles.groupBy("host", "path").agg(
        F.sum("c").alias("pages"),
        F.max("kinds").alias("kinds"),
        (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("spread"),
    )
    texts = nodes.select("host", "path", F.explode("texts").alias("text")).groupBy("host", "path", "text")
    read = texts.agg(F.count("*").alias("c")).groupBy("host", "path").agg(F.avg(F.log("c")).alias("shared"))
    joined = shown.join(read, ["host", "path"], "left")
    base = F.log("pages")
    own_part = F.lit(1.0) - F.pow(F.lit(DECAY), F.col("kinds"))
    content = F.lit(1.0) - F.coalesce(F.col("shared"), F.lit(0.0)) / base
    value = F.when(F.col("pages") > 1, own_part * F.col("spread") / base + (1 - own_part) * content).otherwise(1.0)
    return joined.select("host", "path", "pages", value.alias("importance"))


def extract(pages: DataFrame, page: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """All rows of ``pages`` with ``text``, the main text, and ``n_chars``, its length in code points.

    ``keep`` names the input columns to hand on; without the page itself the stored blocks are small.

    Blocks are joined in page order by two line feeds; white space inside a block is one space; character references
    are decoded. NULL or empty pages give an empty text. Rows without a URL share the host "". Hosts with fewer than
    ``LEAST_PAGES`` pages are judged by tags, classes and roles alone. Pages of a host with the same blocks are one page
    to its tree, and each gets its text. Input columns of the two names are replaced. An empty table gives an empty table.
    """
    added = ["text", "n_chars"]
    columns = carried(pages, added) if keep is None else [c for c in keep if c not in added]

    @F.pandas_udf(PARSED)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            read = [parse(t) for t in texts]
            yield pd.DataFrame(
                {
                    "blocks": [[{"text": t, "node": n} for t, n in b] for b, *_ in read],
                    "paths": [paths for _, _, paths, _ in read],
                    "parents": [parents for *_, parents in read],
                    "place": [_mark(",".join(str(paths[n] if n >= 0 else 0) for _, n in b)) for b, _, paths, _ in read],
                    "nodes": [[{"path": p, "style": s, "kinds": k, "texts": x} for p, s, k, x in n] for _, n, _, _ in read],
                }
            )

    @F.pandas_udf("string")
    def shortened(blocks: pd.Series, paths: pd.Series, parents: pd.Series, removed: pd.Series) -> pd.Series:
        rows = zip(blocks, paths, parents, removed)
        return pd.Series([None if r is None else left_over(b, p, above, r) for b, p, above, r in rows], dtype=object)

    texts = F.transform("parsed.blocks", lambda b: b["text"])
    read = stored(
        pages.select(
            packed(pages, columns).alias("row"),
            F.monotonically_increasing_id().alias("at"),
            host_of(own(url)).alias("host"),
            parsed(own(page)).alias("parsed"),
        ).select("*", F.xxhash64(texts, "parsed.place").alias("mark"), F.xxhash64("parsed.nodes").alias("way"))
    )
    nodes = read.select("at", "host", F.inline("parsed.nodes"))
    firsts = read.groupBy("host", "mark").agg(F.min(F.struct("way", "at")).alias("first"))
    firsts = firsts.select(F.col("first.at").alias("at"))
    copies = stored(read.select("at").join(firsts, "at", "left_anti"))
    repeated = copies.count()
    once = nodes.join(broadcast_below(copies, repeated, 250_000), "at", "left_anti") if repeated else nodes
    low = importance(once).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    low = stored(low.select("host", "path"))
    paths = low.count()
    text = F.array_join(texts, "\n\n")
    if paths:
        hit = nodes.select("at", "host", "path").join(broadcast_below(low, paths, 250_000), ["host", "path"])
        removed = stored(hit.groupBy("at").agg(F.collect_set("path").alias("removed")))  # paths of one page
        removed = broadcast_below(removed.withColumnRenamed("at", "of"), removed.count(), 100_000)
        read = read.join(removed, F.col("at") == F.col("of"), "left")
        # Only pages that lose a node go through the worker again.
        some = [F.when(F.col("removed").isNotNull(), F.col(f"parsed.{c}")) for c in ("blocks", "paths", "parents")]
        text = F.coalesce(shortened(*some, "removed"), text)
    out = read.select("row", text.alias("text"))
    return out.select(*unpacked(columns), "text", F.length("text").cast("long").alias("n_chars"))
