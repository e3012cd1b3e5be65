"""Main text of web pages by wrapper induction.

Pages of a host fall into layouts, by the outline of their upper levels. Each of a
host's commonest layouts gets a pivot, its page of smallest content hash. Every
page is aligned with the pivot of its layout by simple tree matching: equal labels
(tags) match, children are matched in order so that the matched subtrees are
largest, and equal text weighs as much as a node. What the pages of a layout show
at each node of the pivot decides what is kept:

- a text slot that has the same text on nearly all telling pages is template. Copies
  of the pivot tell nothing and don't count;
- the content is the deepest node below which most of the varying text that isn't
  links lies, while that node holds several blocks of a page and leaves no heading
  outside. What aligns outside of it (menus, notices, adverts, footers), varying or
  not, isn't content.

Tags, roles, class tokens and ids decide where there is no template (a host with too
few telling pages, a page that doesn't follow its layout). Inside the content they
only take out lesser parts: what they name goes if it holds less than half of the
text there (comments, share boxes, related links).

Each page is parsed once for the pivots and once to be aligned; what is kept is its
blocks. Counting is an aggregation by (host, layout, node) with map-side sums, so a
host of any size spreads over all tasks. The tables joined to pages (outlines of a
host's pivots, templates) are broadcast while, measured, they are small, and by a
shuffle on the host beyond that.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrid.llm.common import cut, sent_whole, table

# HTML element names by their role, and words of class names and ids.
RAW = set("script style title textarea iframe xmp noembed noframes".split())
SKIPPED = set("head noscript template select datalist option optgroup svg math object canvas audio video".split())
IN_HEAD = set("title meta link script style base noscript template".split())
VOID = set("br hr img input meta link source wbr area base col embed param track".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSED_BY = {
    "p": set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"},
    "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
REGION_TAGS = set("nav aside footer form button dialog menu".split())
REGION_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
REGION_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer share sharing social related recommended "
    "comment comments commentlist disqus reply replies respond pagination pager toolbar search searchbox widget widgets masthead topbar copyright".split()
)
PAGE_WORDS = {"header", "head"}  # of the page, where they stand outside the article
#: Words that may stand beside a region's name in a class token; any other one (no-, has-, with-, article-) makes it another name.
PLACE_WORDS = set("site main page top bottom primary secondary global local bar box block area section list links link item items slot unit".split())
#: Regions by these words, headers and forms may wrap the whole page.
LAYOUT_WORDS = PAGE_WORDS | set("nav navbar navigation menu sidebar aside footer banner masthead topbar toolbar overlay modal popup share sharing social widget widgets".split())
CLEAR, WRAPPED, LAYOUT, REGION = range(4)

# Possessive forms: no place of a page is read again for a tag that doesn't end.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?)*+)(>?)""")
ATTRIBUTE = re.compile(r"""[\s/]++|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("article", "hashed", "kids", "label", "linked", "number", "region", "skipped", "text", "weight")

    def __init__(self, label: str, region: int = CLEAR, article: bool = False, skipped: bool = False):
        self.label, self.region, self.article, self.skipped = label, region, article, skipped
        self.kids: list[Node] = []
        self.text = ""
        self.linked = False
        self.number = self.weight = self.hashed = 0


def attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts, and one without a value is empty."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


@lru_cache(4096)
def named(token: str) -> frozenset[str]:
    """The region words of a class token or id that names a region; none if it has other words than those and places."""
    parts = [w.lower() for w in PARTS.findall(token)]
    words = {"".join(parts)} if "".join(parts) in REGION_WORDS | PAGE_WORDS else set(parts)
    regions = words & (REGION_WORDS | PAGE_WORDS)
    return frozenset(regions) if words <= regions | PLACE_WORDS else frozenset()


def described(tag: str, raw: str, above: Node) -> Node:
    """A node: its label is the tag; whether it is outside the content by what it is called, and whether inside an article."""
    found = attributes(raw) if raw else {}
    role = found.get("role", "").lower()
    starts = tag in ("article", "main") or role in ("article", "main")
    words: set[str] = set()
    if tag not in ("html", "body", "main"):
        words.update(*(named(t) for t in f"{found.get('class', '')} {found.get('id', '')}".split()))
    if above.article or tag == "article":
        words -= PAGE_WORDS
    own = CLEAR
    if tag in REGION_TAGS - {"form"} or role in REGION_ROLES - {"form"} or "hidden" in found or words - LAYOUT_WORDS:
        own = REGION
    elif words or "form" in (tag, role) or tag == "header" and not above.article:
        own = LAYOUT
    inherited = WRAPPED if above.region == LAYOUT and starts and not above.article else above.region
    return Node(tag, max(inherited, own), above.article or starts, above.skipped or tag in SKIPPED)


def parse(page: str | None) -> Node:
    """The tree of block elements; inline elements are part of the text they stand in.

    One pass: an element that never ends, an attribute without its closing quote or
    a tag without its end costs no second look at what follows it.
    """
    page = page or ""
    root = Node("")
    stack, run, linked, link = [root], [], True, 0  # link: the depth at which an open <a> stands, 0 for none
    open_: Counter = Counter()
    missing: set[str] = set()  # endings that the rest of the page doesn't have

    def close() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            top = stack[-1]
            if text and not top.skipped:
                leaf = Node("#", top.region, top.article)
                leaf.text, leaf.linked = text, linked
                top.kids.append(leaf)
        linked = True

    def pop() -> None:
        nonlocal link
        open_[stack.pop().label] -= 1
        if link > len(stack):
            link = 0

    def ending(what: str, at: int, pattern: re.Pattern | None = None) -> int:
        """Where `what` is found from `at` on, or -1; what is missing once is not looked for again."""
        if what in missing:
            return -1
        found = (m.start() if (m := pattern.search(page, at)) else -1) if pattern else page.find(what, at)
        if found < 0:
            missing.add(what)
        return found

    def text(part: str) -> None:
        nonlocal linked
        run.append(part)
        linked = linked and (link > 0 or part.isspace())

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt != at:
            text(page[at : lt if lt >= 0 else len(page)])
            if lt < 0:
                break
        if page.startswith("<!--", lt):
            end = ending("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = ending(">", lt)
            at = end + 1 if end >= 0 else len(page)
            continue
        m = TAG.match(page, lt)
        if m is None:
            text("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if not m[4]:  # the page ends inside a tag
            break
        if tag in INLINE:
            if tag == "a":
                link = 0 if m[1] or ending("</a", at) < 0 else len(stack)
            continue
        if tag in RAW and not m[1]:
            end = -1 if m[3].endswith("/") else ending(f"</{tag}", at, re.compile(rf"</{tag}[\s/>]", re.I))
            if end >= 0:
                at = end
            elif tag in ("script", "style"):
                end = ending("<body", at, re.compile(r"<body[\s/>]", re.I))
                at = end if end >= 0 else len(page)
            run.append(" ")
            continue
        if tag in VOID or tag in RAW:
            run.append(" ")
            continue
        close()
        if m[1]:
            if open_[tag]:
                while stack[-1].label != tag:
                    pop()
                pop()
            continue
        while len(stack) > 1 and (tag in CLOSED_BY.get(stack[-1].label, ()) or stack[-1].label == "head" and tag not in IN_HEAD):
            pop()
        node = described(tag, m[3], stack[-1])
        stack[-1].kids.append(node)
        if not m[3].endswith("/"):
            stack.append(node)
            open_[tag] += 1
    close()
    return root


def measured(root: Node) -> list[Node]:
    """All nodes in page order, each with its number, the weight of its subtree and a hash of it (labels and text)."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo.extend(reversed(node.kids))
    for node in reversed(out):
        node.weight = 1 + bool(node.text) + sum(k.weight for k in node.kids)
        node.hashed = hash((node.label, node.text, tuple(k.hashed for k in node.kids)))
    return out


def mark(text: str) -> str:
    return f"{zlib.crc32(text.encode()):08x}" if text else ""


def outline(root: Node, depth: int = 3) -> str:
    """The upper levels' labels, repeats side by side once; a layout is a hash of it."""
    shown, level = [], [root]
    for _ in range(depth):
        below = []
        for node in level:
            kids = [k for k in node.kids if k.label != "#" and not k.skipped]
            shown.append(",".join(k.label for i, k in enumerate(kids) if not i or kids[i - 1].label != k.label))
            below += kids
        level = below
    return f"{zlib.crc32(';'.join(shown).encode()):08x}"


def skeleton(root: Node) -> str:
    """A tree as JSON: for each node in page order its label, number of children and text hash."""
    return json.dumps([[n.label, len(n.kids), mark(n.text)] for n in measured(root)], separators=(",", ":"))


def restored(text: str) -> Node:
    root: Node | None = None
    open_: list[list] = []
    for label, kids, hashed in json.loads(text):
        node = Node(label)
        node.text = hashed
        if root is None:
            root = node
        else:
            while open_[-1][1] == 0:
                open_.pop()
            open_[-1][0].kids.append(node)
            open_[-1][1] -= 1
        open_.append([node, kids])
    measured(root)
    return root


class Alignment:
    """Simple tree matching of a page with a pivot (both with text hashes as texts).

    Cells of the tables are counted: once `most` are filled, and for lists of
    children whose table alone would be that large, children are paired by equal
    subtrees in order first and by order and label between those, which takes
    time in proportion to the lists.
    """

    def __init__(self, page: Node, pivot: Node, most: int = 60_000):
        self.left, self.known = most, {}
        self.to: dict[int, Node] = {}
        todo = [(page, pivot)]
        while todo:
            a, b = todo.pop()
            self.to[a.number] = b
            if a.kids and b.kids:
                todo += self.paired(a.kids, b.kids)

    def fits(self, p: list[Node], q: list[Node]) -> bool:
        return len(p) * len(q) <= self.left

    def matched(self, a: Node, b: Node) -> int:
        """Weight of the largest matching of two nodes of one label and what is below them."""
        frames = [(a, b)]
        while frames:
            x, y = frames[-1]
            key = (x.number, y.number)
            if key in self.known:
                frames.pop()
                continue
            if x.hashed == y.hashed:
                self.known[key] = x.weight
            elif not x.kids or not y.kids:
                self.known[key] = 1
            elif not self.fits(x.kids, y.kids):
                labels = Counter(k.label for k in x.kids) & Counter(k.label for k in y.kids)
                self.known[key] = 1 + labels.total()
            else:
                below = [(u, v) for u in x.kids for v in y.kids if u.label == v.label and u.label != "#" and (u.number, v.number) not in self.known]
                if below:
                    self.left -= len(below)
                    frames += below
                    continue
                self.known[key] = 1 + self.table(x.kids, y.kids)[-1][-1]
            frames.pop()
        return self.known[a.number, b.number]

    def weight(self, u: Node, v: Node) -> int:
        if u.label != v.label:
            return 0
        if u.label == "#":
            return 1 + (u.text == v.text)
        return self.known.get((u.number, v.number)) or self.matched(u, v)

    def table(self, p: list[Node], q: list[Node]) -> list[list[int]]:
        self.left -= len(p) * len(q)
        best = [[0] * (len(q) + 1)]
        for u in p:
            above, row, last = best[-1], [0], 0
            for j, v in enumerate(q):
                w = above[j] + self.weight(u, v) if u.label == v.label else 0
                last = max(above[j + 1], last, w)
                row.append(last)
            best.append(row)
        return best

    def paired(self, p: list[Node], q: list[Node]) -> list[tuple[Node, Node]]:
        if len(p) == len(q) == 1:
            return [(p[0], q[0])] if p[0].label == q[0].label else []
        if not self.fits(p, q):
            return self.by_order(p, q)
        best, out = self.table(p, q), []
        i, j = len(p), len(q)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((p[i], q[j]))
        return out

    @staticmethod
    def by_order(p: list[Node], q: list[Node]) -> list[tuple[Node, Node]]:
        """Equal subtrees that occur once on each side, as many as keep their order; between two of those, the k-th child of a label with the k-th."""
        at_p, at_q = ({k.hashed: i for i, k in enumerate(side) if n[k.hashed] == 1} for side in (p, q) for n in (Counter(k.hashed for k in side),))
        both = [(i, at_q[h]) for h, i in at_p.items() if h in at_q]
        # Longest increasing run of places in q: for each length, the run that ends earliest.
        ends: list[int] = []
        tops: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(both):
            n = bisect_left(ends, j)
            back.append(tops[n - 1] if n else -1)
            ends[n : n + 1] = [j]
            tops[n : n + 1] = [k]
        chain, k = [(len(p), len(q))], tops[-1] if tops else -1
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        out, i, j = [], 0, 0
        for a, b in reversed(chain):
            gap: dict[str, list[Node]] = {}
            for v in reversed(q[j:b]):
                gap.setdefault(v.label, []).append(v)
            out += [(u, gap[u.label].pop()) for u in p[i:a] if gap.get(u.label)]
            if a < len(p):
                out.append((p[a], q[b]))
            i, j = a + 1, b + 1
        return out


BLOCK = "struct<text:string,node:int,own:boolean,same:boolean,region:int,article:boolean,linked:boolean>"
BLOCKS = f"page_id long, url string, host string, layout string, tells boolean, blocks array<{BLOCK}>"


def hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))


def pivots_of(pages: DataFrame, layouts: int, least_pages: int) -> DataFrame:
    """host, pivots (array of layout and skeleton): the commonest layouts of at least least_pages pages, or else the commonest one; commonest first."""

    def outlined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["host", "layout", "n", "h", "pivot"]
        for b in batches:
            least: dict[tuple[str, str], list] = {}
            for host, page, h in zip(b["host"], b["html"], b["h"], strict=True):
                root = parse(page)
                key = (host, outline(root))
                held = least.setdefault(key, [0, None, ""])
                held[0] += 1
                if held[1] is None or h < held[1]:
                    held[1:] = [h, skeleton(root)]
            yield pd.DataFrame([(*key, *held) for key, held in least.items()], columns=columns)

    parsed = pages.where("host <> ''").select("host", "html", F.xxhash64("html").alias("h"))
    each = parsed.mapInPandas(outlined, "host string, layout string, n long, h long, pivot string").groupBy("host", "layout")
    found = each.agg(F.sum("n").alias("n"), F.min(F.struct("h", "pivot"))["pivot"].alias("pivot"))
    # Of each host the commonest layouts alone are brought together.
    order = Window.partitionBy("host").orderBy(F.desc("n"), "layout")
    top = found.withColumn("k", F.row_number().over(order)).where((F.col("k") <= layouts) & ((F.col("n") >= least_pages) | (F.col("k") == 1)))
    listed = F.sort_array(F.collect_list(F.struct("k", "layout", "pivot")))
    return top.groupBy("host").agg(F.transform(listed, lambda x: F.struct(x["layout"].alias("layout"), x["pivot"].alias("pivot"))).alias("pivots"))


def told(same: list[bool]) -> bool:
    return bool(same) and 2 * sum(same) < len(same)


def aligned(page: str | None, pivots: dict[str, Node], main: str) -> tuple[str, bool, list[tuple]]:
    """The layout whose pivot the page is aligned with, whether the page tells template from content, and its blocks.

    A block has its text, the pivot's node that it aligns with or stands below, whether
    it aligns itself, whether its text is the pivot's, what it is called, whether it
    stands in an article, and whether it is all links.
    """
    root = parse(page)
    layout = outline(root)
    layout = layout if layout in pivots else main
    nodes = measured(root)
    texts = {n.number: n.text for n in nodes if n.text}
    to: dict[int, Node] = {}
    if layout in pivots:
        for n in nodes:
            n.text = mark(n.text)
        measured(root)
        to = Alignment(root, pivots[layout]).to
    below, todo, found = -1, [(root, -1)], []
    while todo:
        node, below = todo.pop()
        other = to.get(node.number)
        below = other.number if other is not None else below
        if node.number in texts:
            found.append((texts[node.number], below, other is not None, other is not None and other.text == node.text, node.region, node.article, node.linked))
        todo += [(k, below) for k in reversed(node.kids)]
    return layout, told([b[3] for b in found if b[2] and not b[6]]), found


def blocks(pages: DataFrame, layouts: int, least_pages: int) -> tuple[DataFrame, DataFrame]:
    """Every page's aligned blocks, and the pivots."""
    pivots = cut(pivots_of(pages, layouts, least_pages))
    names = ["text", "node", "own", "same", "region", "article", "linked"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[str, Node]] = {}
        for b in batches:
            out = []
            for host, page, listed in zip(b["host"], b["html"], b["pivots"], strict=True):
                if listed is not None and host not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[host] = {x["layout"]: restored(x["pivot"]) for x in listed}
                own = known[host] if listed is not None else {}
                layout, tells, found = aligned(page, own, next(iter(own), ""))
                out.append((layout, tells, [dict(zip(names, f, strict=True)) for f in found]))
            got = pd.DataFrame(out, columns=["layout", "tells", "blocks"])
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "host": b["host"], **got})

    size = F.length("host") + F.aggregate("pivots", F.lit(0), lambda n, p: n + F.length(p["pivot"]) + 32)
    joined = pages.join(sent_whole(pivots, size), "host", "left")
    return cut(joined.select("page_id", "url", "html", "host", "pivots").mapInPandas(run, BLOCKS)), pivots


def induced(pivot: Node, seen: dict[int, tuple[int, int, int, int]], pages: int, least_pages: int, constant: float, share: float) -> tuple[int, int, list[int]]:
    """The content's nodes as a range of the pivot's numbers, and its constant text nodes.

    seen: by node, pages whose text aligns there, how often it is the pivot's, and the
    characters and the number of blocks there and below without a node of their own, links left out.
    """
    nodes = measured(pivot)
    fixed = {k for k, (n, same, _, _) in seen.items() if n >= least_pages and same >= constant * n}
    mass, slots, heads, ends = ([0] * len(nodes) for _ in range(4))
    for n in reversed(nodes):
        k = n.number
        own = seen.get(k, (0, 0, 0, 0)) if k not in fixed else (0, 0, 0, 0)
        mass[k] = own[2] + sum(mass[x.number] for x in n.kids)
        slots[k] = own[3] + sum(slots[x.number] for x in n.kids)
        heads[k] = mass[k] if n.label in HEADINGS else sum(heads[x.number] for x in n.kids)
        ends[k] = ends[n.kids[-1].number] if n.kids else k + 1
    at = pivot
    while at.kids:
        best = max(at.kids, key=lambda x: mass[x.number])
        k = best.number
        if mass[k] < share * mass[at.number] or 2 * slots[k] < 3 * pages or heads[k] < heads[at.number]:
            break
        at = best
    return at.number, ends[at.number], sorted(fixed)


TEMPLATE = "host string, layout string, low int, high int, fixed array<int>"


def templates(cut_up: DataFrame, pivots: DataFrame, least_pages: int, constant: float, share: float) -> DataFrame:
    """host, layout, low, high, fixed: for layouts with at least least_pages telling pages."""
    telling = cut_up.where("tells and host <> ''")
    counted = (
        telling.select("host", "layout", F.inline("blocks")).where("node >= 0").groupBy("host", "layout", "node")
        .agg(
            F.sum(F.col("own").cast("long")).alias("n"),
            F.sum(F.col("same").cast("long")).alias("k"),
            F.sum(F.when(F.col("linked"), 0).otherwise(F.length("text"))).alias("chars"),
            F.sum(F.when(F.col("linked"), 0).otherwise(1)).cast("long").alias("slots"),
        )
        .groupBy("host", "layout").agg(F.collect_list(F.struct("node", "n", "k", "chars", "slots")).alias("seen"))
    )
    pages = telling.groupBy("host", "layout").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    listed = pivots.select("host", F.inline("pivots")).select("host", "layout", "pivot")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, layout, pivot, seen, n in zip(b["host"], b["layout"], b["pivot"], b["seen"], b["pages"], strict=True):
                by_node = {x["node"]: (x["n"], x["k"], x["chars"], x["slots"]) for x in seen}
                rows.append((host, layout, *induced(restored(pivot), by_node, n, least_pages, constant, share)))
            yield pd.DataFrame(rows, columns=["host", "layout", "low", "high", "fixed"])

    return cut(counted.join(pages, ["host", "layout"]).join(listed, ["host", "layout"]).mapInPandas(run, TEMPLATE))


def size_of(found) -> F.Column:
    return F.aggregate(found, F.lit(0), lambda n, b: n + F.length(b["text"]))


def by_name(blocks_: str) -> F.Column:
    """Blocks of content by tags, roles, classes and ids alone.

    An article inside a region that only names layout (a wrapper) counts where the page has
    no larger one outside; an article bounds the content where it holds over half of it.
    """
    wrapped = size_of(F.filter(blocks_, lambda b: b["article"] & (b["region"] == WRAPPED)))
    clear = size_of(F.filter(blocks_, lambda b: b["article"] & (b["region"] == CLEAR)))
    kept = F.filter(blocks_, lambda b: (b["region"] == CLEAR) | (b["region"] == WRAPPED) & (wrapped > clear))
    prose = F.filter(kept, lambda b: b["article"] | ~b["linked"])
    inside = F.filter(kept, lambda b: b["article"])
    return F.when(2 * size_of(inside) > size_of(prose), inside).otherwise(prose)


def extract(pages: DataFrame, layouts: int = 4, least_pages: int = 3, constant: float = 0.9, share: float = 0.5, follows: float = 0.05) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html).

    A null html counts as empty and gives an empty text, as does a page without
    content. Pages without a host in their url, layouts with fewer than
    `least_pages` telling pages, and pages with under `follows` of their text in the
    layout's content go by names alone. Repeated rows are extracted each. Other
    columns are ignored; an empty table gives no rows.
    """
    cut_up, pivots = blocks(hosted(pages), layouts, least_pages)
    template = templates(cut_up, pivots, least_pages, constant, share)
    template = sent_whole(template, F.length("host") + F.length("layout") + 4 * F.size("fixed") + 16)
    left = cut_up.join(template, ["host", "layout"], "left")
    fixed = lambda b: b["own"] & b["same"] & F.array_contains("fixed", b["node"])
    inside = F.filter("blocks", lambda b: (b["node"] >= F.col("low")) & (b["node"] < F.col("high")) & (~b["linked"] | b["article"]) & ~fixed(b))
    lesser = F.filter("inside", lambda b: b["region"] < REGION)
    split = left.withColumn("inside", inside).withColumn("lesser", lesser)
    split = split.withColumn("inside", F.when(2 * size_of("lesser") > size_of("inside"), F.col("lesser")).otherwise(F.col("inside")))
    prose = F.filter("blocks", lambda b: ~b["linked"] & ~fixed(b))
    follows_ = F.col("low").isNotNull() & (size_of("inside") >= follows * size_of(prose))
    content = F.when(follows_, F.col("inside")).otherwise(by_name("blocks"))
    return split.select("page_id", "url", F.array_join(F.transform(content, lambda b: b["text"]), "\n").alias("text"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
