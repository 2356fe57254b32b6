"""Main text of web pages by a site style tree.

Every page is parsed once into blocks; a block's style node is the path of its block elements with
their classes. The nodes of all pages of a host are merged by counting: a node's importance is the
larger of two entropies over the host's different pages, that of its content (its texts) and that of its
presentation (which child elements it held, in which order), each as a share of the largest entropy possible. Nodes met
on at least LEAST_PAGES different pages with an importance under LEAST_IMPORTANCE are
removed from each page of the host. Pages that are equal copies count once, so that a mirrored
page doesn't make its own text unimportant.

Elements that never hold main text are left out whatever their importance: scripts, styles, forms,
navigation, site headers and footers, asides, hidden elements, and elements whose class, id or role is the name of a
menu, sidebar, notice, advert or reader comments (outside an article also as part of a hyphenated name, for names that mean nothing else). Where a page has an article (or main) element, only what is inside counts.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by one line feed. Nulls: a null html gives an empty text; the pages of a null or blank url
have no host and keep all nodes; a url without a scheme begins with its host. Broken
markup never fails and takes time in proportion to its length: unclosed elements end with their parent, a
tag that never ends makes the page's later quotes plain signs. Repeated pages give repeated rows.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as markup
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm.tables import table
from spendlight.storage import store

LEAST_PAGES, LEAST_IMPORTANCE = 5, 0.15
#: Unimportant nodes up to which their list is sent to every task (about 50 bytes each); more are joined.
BROADCAST_NODES = 200_000

# fixed values: element names by their part on a page
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NOISE = frozenset("nav footer aside form button select option label dialog menu noscript template iframe object svg canvas audio video map datalist head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar rail widget footer masthead share sharing social related recommended comment comments disqus reply replies "
    "subscribe subscription newsletter login signup search pagination pager toolbar skip hidden".split()
)
# of these, names that also mean it as a part of a longer name, such as site-footer (overflow-hidden isn't hidden)
NOISE_PARTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead comment comments disqus reply replies newsletter pagination pager".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ARTICLE_NAMES = frozenset("article post entry content story main".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
# one attribute after another, each with its whole name and value
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PARTS = re.compile(r"[^a-z0-9]+")


def _look(name: str, rest: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is noise by itself, and its class as part of a style node.

    Inside an article only whole names count, outside also the parts of hyphenated ones.
    """
    noise, style = name in NOISE, ""
    if rest and ("=" in rest or "hidden" in rest):
        names: set[str] = set()
        for key, value in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                names.update(value.split())
                if key == "class":
                    style = "." + ".".join(sorted(value.split()))
            elif key == "role":
                noise = noise or value in NOISE_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                noise = True
        parts = {part for n in names for part in _PARTS.split(n)}
        named = names & NOISE_NAMES or (not inside and parts & NOISE_PARTS)
        if named and name not in ("body", "html", "article", "main") or (name == "article" and parts & {"comment", "reply"}):
            noise = True
        if "header" in parts and not inside and not parts & ARTICLE_NAMES and name in ("div", "section"):
            noise = True
    return noise, style


def tags(page: str):
    """``(text before, closing, name, attributes)`` of each tag in page order, and at last the text after all; name is empty for comments and the like.

    Every place is looked at a bounded number of times, whatever the markup.
    """
    at = scan = 0
    quotes, close = True, page.find(">")
    while True:
        start = page.find("<", scan)
        if 0 <= close < start:
            close = page.find(">", start)
        if start < 0 or close < 0:
            # no later tag can end; a comment may still hide the rest
            hidden = page.find("<!--", scan) if start >= 0 else -1
            yield page[at : hidden if hidden >= 0 else len(page)], "", "", ""
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            yield page[at:start], "", "", ""
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = close + 1
            yield page[at:start], "", "", ""
        elif m := _NAME.match(page, start + 1):
            end, quotes = _tag_end(page, m.end(), quotes)
            yield page[at:start], m[1], m[2].lower(), page[m.end() : end - 1]
            if not m[1] and m[2].lower() in RAW:
                over = re.compile(rf"</{m[2]}[\s>/]", re.I).search(page, end)
                end = over.start() if over else len(page)
        else:
            scan = start + 1
            continue
        at = scan = end


def _tag_end(page: str, at: int, quotes: bool) -> tuple[int, bool]:
    """The place after the tag's end, which isn't within quotes, and whether quotes still mean anything."""
    first = page.find(">", at) + 1
    while quotes:
        stop = _STOP.search(page, at)
        if stop is None:
            return first, False
        if stop[0] == ">":
            return stop.end(), True
        close = page.find(stop[0], stop.end())
        if close < 0:
            return first, False
        at = close + 1
    return first, False


def parse(page: str | None) -> list[tuple[int, str, int]]:
    """``(style node, text, presentation)`` of the blocks that may be main text, in page order.

    Presentation is a hash of the child elements met in the block's element so far.
    """
    if not page:
        return []
    # an open element: name, style node, inside noise, inside an article, its child elements
    stack: list[list] = [["", 0, False, False, 0]]
    named: dict[str, int] = {}
    blocks: list[tuple[int, str, int, bool]] = []
    text: list[str] = []
    any_article = False

    def end_block() -> None:
        if text:
            _, node, _, inside, children = stack[-1]
            joined = " ".join(markup.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((node, joined, children, inside))

    def pop_to(index: int) -> None:
        end_block()
        for gone in stack[index:]:
            named[gone[0]] -= 1
        del stack[index:]

    for chunk, closing, name, rest in tags(page):
        if chunk and not stack[-1][2]:
            text.append(chunk)
        if not name or name in RAW:
            continue
        if closing:
            if named.get(name):
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            continue
        if name in VOID:
            stack[-1][4] = _hash(f"{stack[-1][4]},{name}")
            if name in ("br", "hr") and not stack[-1][2]:
                if name == "hr":
                    end_block()
                else:
                    text.append(" ")
            continue
        block = name in BLOCKS
        noise, style = _look(name, rest, stack[-1][3])
        if not block and not noise:
            stack[-1][4] = _hash(f"{stack[-1][4]},{name}")
            continue
        if name in CLOSES_P and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        while stack[-1][0] in SIBLINGS.get(name, ()):
            pop_to(len(stack) - 1)
        end_block() if block else None
        _, node, in_noise, inside, children = stack[-1]
        stack[-1][4] = _hash(f"{children},{name}{style}")
        if name == "header" and not inside:
            noise = True
        inside = inside or (name in ("article", "main") and not noise and not in_noise)
        any_article = any_article or (inside and name in ("article", "main"))
        if not rest.endswith("/") or block:
            # an inline element left out: the text before it goes on after it
            stack.append([name, _hash(f"{node}>{name}{style}") if block else node, in_noise or noise or not block, inside, 0])
            named[name] = named.get(name, 0) + 1
    end_block()
    return [(node, body, shape) for node, body, shape, inside in blocks if inside or not any_article]


def _hash(x: str) -> int:
    data = x.encode("utf-8", "replace")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data)


def _host():
    host = F.regexp_extract(F.lower("url"), r"^\s*(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)", 1)
    return F.when(host != "", host)


def page_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, body, blocks array<struct<node, text, shape>>)``, one row per page; body is a hash of all its texts."""
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), _host().alias("host"), F.col("html").cast("string").alias("html"))
    item = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.string()), ("shape", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [parse(page) for page in batch.column(3).to_pylist()]
            bodies = [_hash("\n".join(t for _, t, _ in blocks)) for blocks in found]
            rows = [[{"node": node, "text": body, "shape": shape} for node, body, shape in blocks] for blocks in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(bodies, pa.int64()), pa.array(rows, item)], ["page_id", "url", "host", "body", "blocks"])

    return slim.mapInArrow(run, f"page_id {dict(slim.dtypes)['page_id']}, url string, host string, body long, blocks array<struct<node: long, text: string, shape: long>>")


def node_importance(parsed: DataFrame) -> DataFrame:
    """``(host, node, pages, importance)`` of each style node of the merged trees of ``page_blocks``."""
    block = parsed.where(F.col("host").isNotNull()).select("host", "body", F.posexplode(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("text"), b["shape"].alias("shape")))).alias("at", "b"))
    # equal pages have the same blocks, of which one copy counts
    one = block.select("host", "body", "b.node", "at", "b.text", "b.shape").distinct()
    # what a page holds under a node, in page order
    placed = F.sort_array(F.collect_list(F.struct("at", "text", "shape")))
    seen = one.groupBy("host", "node", "body").agg(placed.alias("all")).select("host", "node", F.xxhash64(F.transform("all", lambda x: x["text"])).alias("content"), F.xxhash64(F.transform("all", lambda x: x["shape"])).alias("shape"))
    entropies = []
    for kind in ("content", "shape"):
        by = seen.groupBy("host", "node", kind).agg(F.count(F.lit(1)).alias("n"))
        by = by.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
        share = F.when(F.col("pages") > 1, (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")).otherwise(1.0)
        entropies.append(by.select("host", "node", "pages", share.alias("importance")))
    return entropies[0].union(entropies[1]).groupBy("host", "node", "pages").agg(F.max("importance").alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""
    parsed = store(page_blocks(pages).withColumn("row", F.monotonically_increasing_id()))
    low = store(node_importance(parsed).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)).select("host", "node"))
    if low.count() <= BROADCAST_NODES:
        joined = parsed.join(F.broadcast(low.groupBy("host").agg(F.collect_list("node").alias("low"))), "host", "left")
    else:
        # nodes meet pages without their texts, and each page its own few
        nodes = parsed.where(F.col("host").isNotNull()).select("row", "host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["node"]))).alias("node"))
        marked = store(nodes.hint("merge").join(low.hint("merge"), ["host", "node"]).groupBy("row").agg(F.collect_list("node").alias("low")))
        joined = parsed.hint("merge").join(marked.hint("merge"), "row", "left")
    kept = F.when(F.col("low").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains("low", b["node"])))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text (the main text, blocks joined by newline), n_chars."""
    return extract(table(spark, sf_dir, "pages"))
