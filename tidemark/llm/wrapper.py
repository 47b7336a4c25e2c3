"""Main text of web pages by wrapper induction.

Pages of a host are parted into layouts (pages with the same set of part names).  Reference pages of a layout are merged into one
tree by partial tree alignment: the first one's tree takes in what the others have beside it.  Every page is aligned with its
layout's tree by simple tree matching.  A block that stands at one node of that tree with one and the same text in most pages of
the layout is template; a block whose text varies fills a slot and is content.  Equal texts are also counted over the whole host by
path, of elements and of elements with their classes, so that rare layouts, nodes that a reference lacks and names that differ on every page hide no template.  All counts
cover all pages, once for each distinct text of a page, so that copies don't make content constant.

Names decide only what alignment can't: elements and names of menus, footers, forms, adverts, notices and comments are no slot.
Inside an article a name of several words must hold such a word itself or be one of a list of links (``share-buttons``); others
(``related-work``, ``alert-level``) are left to alignment.  Where a page has article or main elements, the slots inside all parts named
article are taken; names like ``content`` alone decide only if those parts hold most of the text.  A part that names itself article
is one whatever other words stand in its names; words of what it goes without (``no-sidebar``) name nothing.  On pages without
such parts, lists that consist of links only are menus.

Defined cases: a null or empty page gives an empty text; a null URL or one without host belongs to the host ``""``; layouts and
hosts with fewer than ``least_pages`` different pages have no template; unclosed, crossed and unknown elements are read as browsers
do in the main; pages that repeat are treated alike; very long pages, long child lists and deep nesting are matched whole; an empty
table stays empty; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, materialise

# fixed values: elements of the markup language by what they do to text
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol "
    "p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "button", "head", "canvas", "audio", "video"}
NEVER = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
HOLDS = {"ul", "ol", "dl", "table", "div", "section", "article", "body"}
# fixed values: words in class, id and role that name what is not article text
NOT_TEXT = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist respond "
    "reply replies disqus footer masthead copyright legal widget toolbar pagination pager skip hidden complementary contentinfo dialog form teaser outbrain taboola".split()
)
# fixed values: beginnings of names that say what an element has or goes without, not what it is
WITH = {"no", "not", "non", "without", "with", "has", "hide"}
HEAD_NAMES = {"header", "banner", "heading", "byline"}
ARTICLE = {"article", "main", "content", "post", "entry", "story", "maincontent", "articlebody"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# fixed values: words that name what is not article text wherever they stand in a name inside an article
OUTSIDE = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices newsletter subscribe signup login comment comments commentlist respond disqus footer copyright pagination pager hidden form outbrain taboola".split()
)
# fixed values: last words of names that mean a list of links, if another word is one of NOT_TEXT
LISTS = {"links", "buttons", "button", "bar", "box", "list", "posts", "articles", "stories", "items", "icons", "tags", "widget"}

#: cells of a score table that is kept whole; larger ones are halved until they fit, with equal results
CELLS = 10_000

BLOCK = "struct<text:string,node:long,path:long,names:long>"


class Node:
    """A block element: what it is called, its children, and the text pieces between them."""

    __slots__ = ("tag", "name", "skip", "soft", "head", "article", "strong", "up", "children", "blocks", "no", "shape", "size", "path", "names")

    def __init__(self, tag, name, up, skip=False, soft=False, head=False, article=False, strong=False):
        self.tag, self.name, self.up, self.skip, self.soft, self.head, self.article, self.strong = tag, name, up, skip, soft, head, article, strong
        self.children, self.blocks, self.no, self.shape, self.size = [], [], 0, None, 0
        self.path, self.names = (zlib.crc32(f"/{x}".encode("utf-8", "surrogatepass"), y) for x, y in ((tag, up.path if up else 0), (name, up.names if up else 0)))


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def element(tag: str, raw: str, up: Node | None) -> Node:
    a = attributes(raw)
    names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"
    parts = [[w.lower() for w in WORD.findall(x)] for x in names.split()]
    parts = [x for x in parts if x and x[0] not in WITH]
    words = {w for x in parts for w in x}
    root = tag in ("html", "body", "main")
    unseen = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    # the last word of a name says what it names: a legal-notice-article is an article, post-comments are none
    named = tag in ("article", "main") or (tag in ("div", "section", "td") and any(x[-1] in ARTICLE for x in parts))
    hard = any(x[0] in NOT_TEXT if len(x) == 1 else OUTSIDE & set(x) or (x[-1] in LISTS and NOT_TEXT & set(x)) or (x[-1] in NOT_TEXT and x[0] in ARTICLE) for x in parts)
    skip = not root and (tag in NEVER or (hard and not named) or unseen)
    soft = not root and bool(words & NOT_TEXT) and not named
    strong = tag in ("article", "main") or a.get("role", "").lower() in ("article", "main")
    head = not root and (tag == "header" or bool(words & HEAD_NAMES))
    return Node(tag, f"{tag}.{a.get('class', '')}", up, skip, soft, head, named or strong or (tag in ("div", "section", "td") and bool(words & ARTICLE)), strong)


def parse(html: str) -> Node:
    """The tree of block elements; each text block is (place in page, text, is it all link) of its element."""
    from html import unescape

    root = Node("html", "html.", None)
    at, here, order, link = 0, root, 0, 0
    piece: list[str] = []
    linked = total = 0

    def text(raw: str):
        nonlocal linked, total
        if raw:
            piece.append(raw)
            size = sum(map(len, raw.split()))
            total += size
            linked += size if link else 0

    def flush():
        nonlocal order, linked, total
        if piece:
            clean = " ".join(unescape("".join(piece)).split())
            if clean:
                here.blocks.append((order, clean, linked == total))
                order += 1
            piece.clear()
        linked = total = 0

    m = TOKEN.search(html, at)
    while m:
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag:
            tag = tag.lower()
            closing = m[1] == "/"
            if tag in RAW and not closing and not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style", "title", "textarea"):
                    at = len(html)
                if tag not in ("noscript", "select", "button"):
                    flush()
            elif tag == "a":
                link = 0 if closing else 1
            elif tag in ("br", "hr"):
                flush()
            elif tag in BLOCKS:
                flush()
                link = 0
                if closing:
                    up = here
                    while up is not None and up.tag != tag:
                        up = up.up
                    if up is not None and up.up is not None:
                        here = up.up
                elif tag == "html":
                    pass
                else:
                    ends = CLOSES.get(tag)
                    up = here
                    while up.up is not None and (up.tag == "p" or (ends and up.tag in ends) or (ends and up.tag not in HOLDS)):
                        if ends and up.tag in ends:
                            here = up.up
                        elif up.tag == "p":
                            here = up.up
                        up = up.up
                    if m[3].endswith("/"):
                        pass
                    else:
                        child = element(tag, m[3], here)
                        here.children.append(child)
                        here = child
        m = TOKEN.search(html, at)
    text(html[at:])
    flush()
    number(root)
    return root


def number(root: Node) -> None:
    """Numbers in page order, and shapes (equal shapes: equal trees of names) with their sizes."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.no = len(order)
        order.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(order):
        node.shape = hash((node.name, tuple(c.shape for c in node.children)))
        node.size = 1 + sum(c.size for c in node.children)


def match(a: Node, b: Node, known: dict) -> int:
    """Simple tree matching: the size of the largest order-keeping match of two trees, roots matched.

    Pairs of subtrees wait on a stack of our own, so nesting may be of any depth.
    """
    if a.name != b.name:
        return 0
    if a.shape == b.shape:
        return a.size
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if (x.shape, y.shape) in known:
            stack.pop()
            continue
        lo, hx, hy = _middle(x.children, y.children)
        xs, ys = ({c.shape: c for c in side}.values() for side in (x.children[lo:hx], y.children[lo:hy]))
        names: dict = {}
        for d in ys:
            names.setdefault(d.name, []).append(d)
        missing = [(c, d) for c in xs for d in names.get(c.name, ()) if c.shape != d.shape and (c.shape, d.shape) not in known]
        if missing:
            stack += missing
            continue
        ends = sum(c.size for c in x.children[:lo]) + sum(c.size for c in x.children[hx:])
        known[x.shape, y.shape] = 1 + ends + _scores(x.children[lo:hx], y.children[lo:hy], known)[-1]
        stack.pop()
    return known[a.shape, b.shape]


def _middle(xs: list[Node], ys: list[Node]) -> tuple[int, int, int]:
    """What is left of two lists of children once equal ends are taken off."""
    lo, hx, hy = 0, len(xs), len(ys)
    while lo < hx and lo < hy and xs[lo].shape == ys[lo].shape:
        lo += 1
    while hx > lo and hy > lo and xs[hx - 1].shape == ys[hy - 1].shape:
        hx, hy = hx - 1, hy - 1
    return lo, hx, hy


def _weight(x: Node, y: Node, known: dict) -> int:
    return 0 if x.name != y.name else x.size if x.shape == y.shape else match(x, y, known)


def _scores(xs: list[Node], ys: list[Node], known: dict) -> list[int]:
    """Weight of the best match of all of ``xs`` with each beginning of ``ys``; memory grows with ``ys`` only."""
    if len(xs) * len(ys) <= CELLS:
        return _table(xs, ys, known)[-1]
    import numpy as np

    kinds: dict = {}
    at = np.fromiter((kinds.setdefault(y.shape, (len(kinds), y))[0] for y in ys), np.int64, len(ys))
    firsts = [y for _, y in kinds.values()]
    weights: dict = {}
    row = np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        if x.shape not in weights:
            if len(weights) * len(firsts) > 1_000_000:  # a cache only
                weights.clear()
            weights[x.shape] = np.fromiter((_weight(x, y, known) for y in firsts), np.int64, len(firsts))
        new = row.copy()
        np.maximum(row[1:], row[:-1] + weights[x.shape][at], out=new[1:])
        row = np.maximum.accumulate(new)
    return row.tolist()


def _table(xs: list[Node], ys: list[Node], known: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = rows[-1], [0]
        for j, y in enumerate(ys):
            w = _weight(x, y, known)
            row.append(max(above[j + 1], row[j], above[j] + w if w else 0))
        rows.append(row)
    return rows


def _pairs(xs: list[Node], ys: list[Node], known: dict) -> list[tuple[Node, Node]]:
    """The pairs of a best match; tables too large to keep are halved, and the best place to part the other list found from both ends."""
    out, stack = [], [(xs, ys)]
    while stack:
        xs, ys = stack.pop()
        if not xs or not ys:
            continue
        if len(xs) * len(ys) <= CELLS or len(xs) == 1:
            if len(xs) == 1:
                w, j = max((_weight(xs[0], y, known), -j) for j, y in enumerate(ys))
                out += [(xs[0], ys[-j])] if w else []
                continue
            rows = _table(xs, ys, known)
            i, j = len(xs), len(ys)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((xs[i], ys[j]))
            continue
        half = len(xs) // 2
        first = _scores(xs[:half], ys, known)
        last = _scores(xs[half:][::-1], ys[::-1], known)
        cut = max(range(len(ys) + 1), key=lambda j: first[j] + last[len(ys) - j])
        stack += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
    return out


def align(a: Node, b: Node, known: dict, to: dict[int, Node]) -> None:
    """``to[number in a]`` = the node of b that it matches, by simple tree matching."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.name != y.name:
            continue
        to[x.no] = y
        lo, hx, hy = _middle(x.children, y.children)
        stack += zip(x.children[:lo], y.children[:lo], strict=True)
        stack += zip(x.children[hx:], y.children[hy:], strict=True)
        stack += _pairs(x.children[lo:hx], y.children[lo:hy], known)


def merge(base: Node, other: Node) -> None:
    """Partial tree alignment: nodes of ``other`` that match nothing go into ``base`` behind their last matched sister."""
    to: dict[int, Node] = {}
    align(other, base, {}, to)
    stack = [other]
    while stack:
        node = stack.pop()
        place, last = to[node.no], None
        for child in node.children:
            if child.no in to:
                last = to[child.no]
                stack.append(child)
            else:
                at = 0 if last is None else next(i for i, c in enumerate(place.children) if c is last) + 1
                child.up = place
                place.children.insert(at, child)
                last = child
    number(base)


def slots(root: Node) -> list[tuple[Node, int, str]]:
    """The page's possible article blocks, in page order: those of all parts that it names article, else all that may be text.

    Of nested parts the outermost counts, so that no text beside an inner one is lost.
    """
    kept = []
    linked: dict[int, list] = {}  # per node: blocks below it, are they all links
    seen, stack = [], [(root, False, False, False)]
    while stack:
        node, head, inside, strong = stack.pop()
        if node.skip or (node.soft and not inside):
            continue
        inside, strong = inside or node.article, strong or node.strong
        seen.append(node)
        head = head or node.head
        if not head or node.tag in HEADINGS:
            kept += [(node, order, text, link, inside, strong) for order, text, link in node.blocks]
        stack += [(c, head, inside, strong) for c in node.children]
    whole, article = (sum(len(x[2]) for x in kept if x[4] or every) for every in (True, False))
    if article and (2 * article > whole or any(x[5] for x in kept)):
        rows = [x for x in kept if x[4]]
    else:
        for node in reversed(seen):
            own = linked.setdefault(node.no, [0, True])
            own[0] += len(node.blocks)
            own[1] = own[1] and all(x[2] for x in node.blocks)
            if node.up is not None:
                above = linked.setdefault(node.up.no, [0, True])
                above[0] += own[0]
                above[1] = above[1] and own[1]
        menu = {no for no, (n, links) in linked.items() if links and n > 1}
        rows = [x for x in kept if not (x[3] and (x[0].no in menu or (x[0].up is not None and x[0].up.no in menu)))]
    return [x[:3] for x in sorted(rows, key=lambda x: x[1])]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


# fixed values: elements that part a page
PART = r"(?i)<((?:body|main|article|section|div|nav|header|footer|aside|form|table)\b[^>]*)"


def layout_of(html: Column) -> Column:
    """A hash of the set of a page's parts, each with its class without long numbers."""
    part = lambda x: F.concat_ws(
        ".", F.lower(F.regexp_extract(x, r"^\w+", 0)), F.regexp_replace(F.regexp_extract(x, "(?i)\\bclass\\s*=\\s*[\"']?([^\"'>]*)", 1), "[0-9]{3,}", "")
    )
    return F.xxhash64(F.concat_ws("|", F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(PART), F.lit(1)), part)))))


def extract_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", references: int = 3, least_pages: int = 4, constant: float = 0.8, template: bool = True,
) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and ``n_chars``.

    ``references`` pages of every layout make its tree.  Without ``template`` blocks stay that are constant.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("layout", layout_of(F.col("html")))
    rank = F.xxhash64("html")
    # the pages of lowest hash in each of a few parts of a layout: partial aggregates, one page held for each
    chosen = rows.groupBy("host", "layout", F.pmod(rank, F.lit(references)).alias("part")).agg(F.min(F.struct(rank.alias("rank"), "html")).alias("least"), F.count("*").alias("n"))
    refs = chosen.groupBy("host", "layout").agg(F.collect_list("least.html").alias("pages"), F.sum("n").alias("n")).where(F.col("n") >= least_pages)  # at most ``references`` pages

    def merged(batches):
        import pickle

        import pyarrow as pa

        for batch in batches:
            made = []
            for found in batch.column(2).to_pylist():
                base, *others = [parse(x) for x in sorted(found)]
                for other in others:
                    merge(base, other)
                made.append(pickle.dumps(_plain(base)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], names=["t_host", "t_layout", "wrapper"])

    bounded_batches(rows)
    wrappers = materialise(refs.mapInArrow(merged, "t_host string, t_layout long, wrapper binary"), "wrappers")

    def blocks(batches):
        import pickle

        import pyarrow as pa

        opened: dict = {}
        kinds = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int64()), ("path", pa.int64()), ("names", pa.int64())]))
        for batch in batches:
            out = []
            for host, layout, html, blob in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                tree = parse(html)
                to: dict[int, Node] = {}
                if blob is not None:
                    if (host, layout) not in opened:
                        if len(opened) > 500:
                            opened.clear()
                        opened[host, layout] = _tree(pickle.loads(blob)), {}
                    base, known = opened[host, layout]
                    if len(known) > 200_000:
                        known.clear()
                    align(tree, base, known, to)
                out.append([{"text": text, "node": to[node.no].no if node.no in to else -1, "path": node.path, "names": node.names} for node, _, text in slots(tree)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, kinds)], names=["page_id", "url", "host", "layout", "blocks"])

    on = (F.col("host") == F.col("t_host")) & (F.col("layout") == F.col("t_layout"))
    joined = rows.join(wrappers, on, "left").select("page_id", "url", "host", "layout", "html", "wrapper")
    found = joined.mapInArrow(blocks, f"page_id long, url string, host string, layout long, blocks array<{BLOCK}>")
    left = F.col("blocks")
    if template:
        found = materialise(found, "page-blocks")
        fixed = materialise(_fixed(found, least_pages, constant), "templates")
        found = found.join(fixed, on, "left")
        kept = F.filter("blocks", lambda b: ~F.arrays_overlap("fixed", F.array(*(_key(kind, b) for kind in PLACES))))
        left = F.when(F.col("fixed").isNull(), F.col("blocks")).otherwise(kept)
    text = F.concat_ws(" ", F.transform(left, lambda b: b["text"]))
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


#: what blocks of different pages are held together by: the node of the layout's tree, element path, path of elements with classes
PLACES = ("node", "path", "names")


def _key(kind: str, b: Column) -> Column:
    return F.xxhash64(F.lit(kind), b[kind], b["text"])


def _fixed(found: DataFrame, least_pages: int, constant: float) -> DataFrame:
    """Per layout (``t_host``, ``t_layout``) the keys of its constant blocks: by node within the layout, by paths within the host.

    A page counts once for a place, and once for each text at it; pages with the same texts count as one.
    """
    short = F.transform("blocks", lambda b: F.struct(*(b[k].alias(k) for k in PLACES), *(_key(k, b).alias(f"{k}_key") for k in PLACES)))
    different = found.groupBy("host", F.xxhash64("blocks.text").alias("content")).agg(F.min(F.struct("layout", short.alias("b"))).alias("p")).select("host", "p.layout", "p.b")
    none = F.lit(None).cast("long")
    spot = lambda kind, b, key: F.struct(F.lit(kind).alias("kind"), b[kind].alias("place"), key.alias("key"))
    every = F.flatten(F.transform("b", lambda b: F.array(*(x for k in PLACES for x in (spot(k, b, b[f"{k}_key"]), spot(k, b, none))))))
    spots = different.select("host", "layout", F.explode(F.array_distinct(every)).alias("s")).where("s.place >= 0")
    counts = materialise(spots.groupBy("host", "layout", "s.kind", "s.place", "s.key").agg(F.count("*").alias("n")), "page-spots")

    def constant_of(rows: DataFrame, group: list[str]) -> DataFrame:
        mine = rows.groupBy(*group, "place", "key").agg(F.sum("n").alias("n"))
        seen = mine.where("key is null").select(*group, "place", F.col("n").alias("seen"))
        return mine.where(F.col("key").isNotNull() & (F.col("n") >= least_pages)).join(seen, [*group, "place"]).where(F.col("n") >= constant * F.col("seen"))

    by_node = constant_of(counts.where("kind = 'node'"), ["host", "layout"]).select("host", "layout", "key")
    by_path = constant_of(counts.where("kind != 'node'"), ["host", "kind"]).select("host", "kind", "place", "key")
    by_path = counts.join(by_path, ["host", "kind", "place", "key"]).select("host", "layout", "key")
    return by_node.unionByName(by_path).groupBy(F.col("host").alias("t_host"), F.col("layout").alias("t_layout")).agg(F.collect_set("key").alias("fixed"))


def _plain(root: Node) -> list[tuple[int, str]]:
    """A tree without its texts: depth and name of its nodes in page order."""
    out, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        out.append((depth, node.name))
        stack += [(c, depth + 1) for c in reversed(node.children)]
    return out


def _tree(plain: list[tuple[int, str]]) -> Node:
    open_: list[Node] = []
    for depth, name in plain:
        del open_[depth:]
        node = Node(name.split(".", 1)[0], name, open_[-1] if open_ else None)
        if open_:
            open_[-1].children.append(node)
        open_.append(node)
    number(open_[0])
    return open_[0]
