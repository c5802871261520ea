"""Main text of web pages, with site templates removed.

Each page is read into a tree once, without recursion, so any depth will do.
Every element's subtree is hashed from its tag, class, text and children;
Spark counts on how many pages of a host each hash occurs, and subtrees that
recur on many of them are templates, which are deleted.  Elements whose tag,
role or class says that they are not main text (menus, footers, adverts,
forms, comments and the like) go anyway.

The main text is that of the page's articles if it has any, else of <main>,
else of the whole body.  Where an article says what the text is, only subtrees
without prose (paragraphs, headings, lists and the like) can go as templates
inside it, so that an article, or a passage of it, published on many pages
stays whole.  Where nothing says so, any recurring subtree goes.
"""

from __future__ import annotations

import re
from functools import partial
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import utf8_batches, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|select|math|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # quotes belong to an attribute's value only where they open it and close again; else the tag ends at the next ">"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"<]*\"|=\s*'[^'<]*'|=)*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td figcaption".split())
_CLOSES_P = _BLOCKS - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIERS = frozenset("ul ol dl table div section article aside nav main body td th".split())
_DROPPED = frozenset("head title nav footer aside form button menu dialog label input".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Fixed values, the fallback where no template is known.  A class or id names a part that is no main text when all its hyphenated words
#: are in these lists and one is in the first: "site-footer" and "ad" do, "notice-board", "share-price" and "social" do not.
_PARTS = frozenset(
    "ad ads advert advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs share sharing comment comments disqus respond related recommended recommendations newsletter subscribe footer masthead toolbar paywall".split()
)
_WITH = frozenset("site page post article main global top bottom left right side wrapper container area section box bar list links buttons block widget social content inner header form message".split())


#: Reader comments are often articles of their own.
_COMMENT = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])", re.I)


def _is_part(names: str) -> bool:
    """Whether a class or id attribute names a part that is no main text."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if any(w in _PARTS for w in words) and all(w in _PARTS or w in _WITH or w.isdigit() for w in words):
            return True
    return bool({"site-header", "page-header"} & {*names.lower().split()})


class _Node:
    __slots__ = ("children", "dropped", "hash", "name", "prose", "tag")

    def __init__(self, tag: str, name: str = "", dropped: bool = False):
        self.tag, self.name, self.dropped = tag, name, dropped
        self.children: list = []
        self.hash, self.prose = 0, tag in _PROSE


def parse(html: str) -> _Node:
    """A tree of elements and texts; tags left open or closed in the wrong order are mended as browsers do, roughly."""
    root = _Node("#root")
    stack = [root]
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _VOID:
            stack[-1].children.append(" " if tag in ("br", "wbr", "img") and tag != "wbr" else _Node(tag) if tag == "hr" else "")
            continue
        if tag in _CLOSES_P:
            _close(stack, {"p"}, _BARRIERS)
        if tag in _CLOSED_BY:
            _close(stack, _CLOSED_BY[tag], {"ul", "ol", "dl", "menu", "table"} - _CLOSED_BY[tag])
        said = {}
        if m[4].strip():
            said = {a.lower(): (x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m[4])}
        name = f"{said.get('class', '')} {said.get('id', '')}".strip()
        dropped = tag in _DROPPED or "hidden" in said or said.get("aria-hidden", "").lower() == "true" or said.get("role", "").lower() in _ROLES
        node = _Node(tag, name, dropped or bool(name and tag not in ("html", "body", "article", "main") and _is_part(name)) or (tag == "article" and bool(_COMMENT.search(name))))
        stack[-1].children.append(node)
        if not m[4].rstrip().endswith("/") or tag in _BLOCKS:
            stack.append(node)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def _close(stack: list[_Node], tags: set[str], barriers) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in barriers:
            return


def _in_order(root: _Node) -> list[_Node]:
    """All elements, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def _hash_all(root: _Node) -> set[int]:
    """Hashes every subtree, children first; those of blocks."""
    from xxhash import xxh64

    hashes: set[int] = set()
    for node in reversed(_in_order(root)):
        h = xxh64(f"{node.tag}\0{node.name}")
        for c in node.children:
            if isinstance(c, str):
                if text := " ".join(c.split()):
                    h.update(b"\1" + text.encode())
            else:
                node.prose |= c.prose
                h.update(c.hash.to_bytes(8, "big", signed=True))
        x = h.intdigest()
        node.hash = x - (1 << 64) if x >> 63 else x
        if node.tag in _BLOCKS:
            hashes.add(node.hash)
    return hashes


def _outermost(root: _Node, tag: str) -> list[_Node]:
    """Elements of the tag that are in no dropped element and in no other of the tag, in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.dropped:
            continue
        if node.tag == tag:
            found.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return found


def segments(html: str) -> tuple[list[int], list[str], list[tuple[int, int, int]]]:
    """(distinct subtree hashes of the page, blocks of its main text, and (hash, from, to) of the subtrees that may take those blocks away)."""
    root = parse(html)
    hashes = _hash_all(root)
    mains = _outermost(root, "article")
    article = bool(mains)
    out: list[str] = []
    spans: list[tuple[int, int, int]] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = " ".join(unescape("".join(line)).split())
            if text:
                out.append(text)
            line.clear()

    def close(hashed: int, at: int) -> None:
        end()
        if len(out) > at:
            spans.append((hashed, at, len(out)))

    todo: list = []  # texts, elements, and what is to be done after an element's children
    for main in mains or _outermost(root, "main") or [root]:
        todo = [end, *reversed(main.children)]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                line.append(c)
            elif callable(c):
                c()
            elif not c.dropped and not (c.tag == "header" and not (article and c.prose)):
                block = c.tag in _BLOCKS
                if block:
                    end()
                    may_go = c.tag not in ("html", "body") and not (article and c.prose)
                    todo.append(partial(close, c.hash, len(out)) if may_go else end)
                todo.extend(reversed(c.children))
    return sorted(hashes), out, spans


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    return m[1].lower() if m else ""


def main_text(pages: DataFrame, min_pages: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each row of pages.

    A subtree is a template when it is on at least min_pages pages of its host,
    however many pages that has: a section's menu is one too.  Character references are
    decoded, white space inside a block becomes one space, blocks are trimmed
    and joined in page order by two line breaks.  A null or empty page, or one
    without main text, gives an empty text.  A null url, or one without a
    host, belongs to the host ''.  Repeated rows count as pages of their own;
    an empty table gives no rows.  Elements may be nested to any depth, and
    pages be of any length.  Other columns may have any names and are not read.

    Counting is by partial aggregates, and only pages with blocks that a
    template could take away are joined with the templates, by (host, hash).
    """

    under = pa.list_(pa.struct([("hash", pa.int64()), ("from", pa.int32()), ("to", pa.int32())]))

    def read(batches):
        for keys, urls, htmls in utf8_batches(batches, ["id", "url", "html"], 64):
            seen, segs, spans = zip(*(segments(h or "") for h in htmls))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(urls, pa.string()),
                    pa.array(map(host_of, urls), pa.string()),
                    pa.array([np.array(s, np.int64) for s in seen], pa.list_(pa.int64())),
                    pa.array(segs, pa.list_(pa.string())),
                    pa.array([[{"hash": h, "from": a, "to": b} for h, a, b in s] for s in spans], under),
                ],
                ["id", "url", "host", "seen", "segs", "spans"],
            )

    kind = "id long, url string, host string, seen array<bigint>, segs array<string>, spans array<struct<hash:bigint,from:int,to:int>>"
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    trees = written(source.mapInArrow(read, kind).withColumn("row", F.monotonically_increasing_id()), "pages")
    templates = (
        trees.select("host", F.explode("seen").alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count("*").alias("on"))
        .where(F.col("on") >= min_pages)
        .select("host", "hash")
    )
    may_change = F.size("spans") > 0
    asked = trees.where(may_change).select("row", "host", F.explode("spans").alias("span")).select("row", "host", F.col("span.hash").alias("hash"), "span")
    gone = asked.join(templates, ["host", "hash"]).groupBy("row").agg(F.collect_set(F.struct("span.from", "span.to")).alias("gone"))  # of one page's subtrees
    taken = lambda i: F.exists("gone", lambda g: (g["from"] <= i) & (i < g["to"]))
    kept = F.when(F.col("gone").isNull(), F.col("segs")).otherwise(F.filter("segs", lambda s, i: ~taken(i)))
    changed = trees.where(may_change).join(gone, "row", "left").select("id", "url", kept.alias("segs"))
    whole = trees.where(~may_change).select("id", "url", "segs")
    text = F.array_join("segs", "\n\n")
    return whole.unionAll(changed).select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))
