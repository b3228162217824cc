"""HTML extraction by nearest-URL page differencing.

Pages of a host are ordered by URL path, and each is compared with its neighbours there: the nearest URLs. Lines of
text are aligned by longest common subsequence, and shared lines are deleted as the site's own.

On pages whose markup names the article, the difference alone is wrong both ways: menus, adverts and footers that vary
from page to page are not shared, and article lines that mirrored pages repeat are. So markup decides first: what
stands in elements for navigation, adverts, forms, comments and the like is never text, and shared lines are deleted
only outside of an article's own element.

Pages are ordered by one range sort of narrow rows (host, path and hashes of lines, no text), so no host is one task,
and pairs are equi-joins on the place in that order.

Defined cases: null html is empty and gives empty text; a null or malformed URL belongs to the empty host; repeated
rows give a row each and are no neighbours of themselves; null ids are allowed; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)|[^<]+|<", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)""", re.I)
#: Their content is text of no kind, up to the end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Never part of the article.
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "svg", "math", "object", "canvas", "audio", "video", "map", "fieldset", "input", "label", "search", "header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
PARTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adbox", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "crumbs", "sidebar", "side", "aside",
    "widget", "widgets", "footer", "foot", "header", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond", "share", "sharing", "social", "related",
    "recommended", "recommendations", "pagination", "pager", "login", "search", "searchbox", "form", "skip", "copyright", "legal", "disclaimer", "tags", "toc", "teaser", "outbrain", "taboola",
}
MAIN = {"article", "main"}
#: End tags that a start tag or another end tag implies.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _unwanted(name: str, tag: str) -> bool:
    if name in DROPPED:
        return True
    for m in ATTRIBUTE.finditer(tag[len(name) + 1 :]):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and not PARTS.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


def lines(page: str) -> list[tuple[str, bool]]:
    """(line, whether it stands in an article's own element) for each block of text in page order."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, inside main
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((text, bool(stack) and stack[-1][2]))

    raw = None
    for m in TOKEN.finditer(page):
        token = m[0]
        tag = TAG.match(token)
        if raw is not None:
            if tag and tag[1] and tag[2].lower() == raw:
                raw = None
            continue
        if tag is None:
            if token[0] != "<" or token == "<":
                if not (stack and stack[-1][1]):
                    parts.append(token)
            elif token.startswith("<![CDATA[") and not (stack and stack[-1][1]):
                parts.append(html.escape(token[9:].removesuffix("]]>")))
            continue
        name = tag[2].lower()
        if tag[1]:
            if name in BLOCK:
                flush()
            if any(s[0] == name for s in stack) and not (name not in BLOCK and _barred(stack, name)):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in RAW:
            if not token.endswith("/>"):
                raw = name
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            flush()
            if stack and stack[-1][0] == "p" or name in CLOSES:
                closed = CLOSES.get(name, set()) | {"p"}
                while stack and (stack[-1][0] in closed or stack[-1][0] not in BLOCK and any(s[0] in closed for s in stack[-6:]) and not stack[-1][1]):
                    stack.pop()
        if name in VOID:
            continue
        dropped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        stack.append((name, dropped or _unwanted(name, token), main or name in MAIN or "articlebody" in token.lower()))
    flush()
    return out


def _barred(stack: list[tuple[str, bool, bool]], name: str) -> bool:
    """Whether an inline end tag would reach past a block."""
    for s in reversed(stack):
        if s[0] == name:
            return False
        if s[0] in BLOCK:
            return True
    return True


def page_lines(page: str) -> list[tuple[str, bool]]:
    """Lines with character references decoded (in each block, before white space is collapsed)."""
    found = [(" ".join(html.unescape(t).split()), inside) for t, inside in lines(page)]
    return [x for x in found if x[0]]


def shared(own: list[int], other: list[int]) -> set[int]:
    """Indices of own that lie on a longest common subsequence with other; bit-parallel, a row of bits a line. Rows are
    kept at the beginnings of blocks only and made again block by block on the way back, so the memory grows with the
    root of the number of lines, not with the number."""
    a, b = 0, 0
    while a < min(len(own), len(other)) and own[a] == other[a]:
        a += 1
    while b < min(len(own), len(other)) - a and own[-1 - b] == other[-1 - b]:
        b += 1
    found = {*range(a), *range(len(own) - b, len(own))}
    x, y = own[a : len(own) - b], other[a : len(other) - b]
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1

    def after(row: int, v: int) -> int:
        hit = row & where.get(v, 0)
        return ((row + hit) | (row - hit)) & full

    size = max(1, math.isqrt(len(x)))
    firsts, row = [], full  # the row before each block
    for i, v in enumerate(x):
        if i % size == 0:
            firsts.append(row)
        row = after(row, v)
    # A zero bit j of row i says that the length grows at column j; walk back over the growths.
    j = len(y) - 1
    for block in reversed(range(len(firsts))):
        rows = [firsts[block]]
        for v in x[block * size : (block + 1) * size]:
            rows.append(after(rows[-1], v))
        i = len(rows) - 2  # rows[i + 1] is the row of line block * size + i
        while i >= 0 and j >= 0:
            if rows[i + 1] >> j & 1:
                j -= 1
            elif not rows[i] >> j & 1 and block * size + i > 0:
                i -= 1
            else:
                found.add(a + block * size + i)
                i, j = i - 1, j - 1
    return found


def _hash(line: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page_key, deleted): for pages that share lines with a neighbour outside of articles, which lines go."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_lines(p or "") for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([[_hash(t) for t, _ in p] for p in found], pa.list_(pa.int64())), pa.array([[not inside for _, inside in p] for p in found], pa.list_(pa.bool_()))],
                names=["page_key", "host", "path", "hashes", "outside"],
            )

    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    keyed = pages.select(page_key().alias("page_key"), host.alias("host"), path.alias("path"), "html")
    narrow = keyed.mapInArrow(digest, "page_key long, host string, path string, hashes array<long>, outside array<boolean>")
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.dropDuplicates(["page_key"]).repartitionByRange(parts, "host", "path", "page_key").sortWithinPartitions("host", "path", "page_key")
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()))
    # The place in the whole order: the rows of earlier partitions and the place in one's own.
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("part")).count().collect()}  # a row for each partition
    first, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    offsets = F.array(*(F.lit(x) for x in first)) if first else F.array(F.lit(0))
    placed = ordered.withColumn("place", F.element_at(offsets, (part + 1).cast("int")) + inside).drop("at")
    pairs = []
    for step in (-1, 1):
        other = placed.select((F.col("place") + step).alias("place"), F.col("host").alias("other_host"), F.col("path").alias("other_path"), F.col("hashes").alias("other"))
        pairs.append(placed.join(other, "place").where("host = other_host"))
    both = pairs[0].unionByName(pairs[1])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("page_key", "hashes", "outside", "other")), strict=True)
            found = [(key, sorted(i for i in shared(own, other) if outside[i])) for key, own, outside, other in rows]
            found = [x for x in found if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.list_(pa.int32()))], names=["page_key", "deleted"])

    deleted = both.select("page_key", "hashes", "outside", "other").mapInArrow(align, "page_key long, deleted array<int>")
    return deleted.groupBy("page_key").agg(F.array_distinct(F.flatten(F.collect_list("deleted"))).alias("deleted"))  # two rows a page at most


def page_key():
    return F.xxhash64("page_id", "url", "html")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    narrow = pages.select("page_id", "url", "html")
    joined = narrow.withColumn("page_key", page_key()).join(shared_lines(narrow), "page_key", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, deleted in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = set(deleted or ())
                texts.append("\n".join(t for i, (t, _) in enumerate(page_lines(page or "")) if i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "deleted").mapInArrow(write, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
