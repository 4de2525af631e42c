"""Operator 6: main text of web pages by wrapper induction.

Pages become small trees of containers and text blocks. Pages of one host meet in groups
(hosts with very many pages in several groups), where each page is aligned with a few
reference pages by simple tree matching. Nodes that are matched with equal text are
constant: they belong to the host's template. Slots whose text varies are candidates for
content. From these, blocks inside the article are taken, or all that is left where a page
marks none; menus, forms, adverts and the like go by their tags, classes and share of links.

Cases: null and empty html give an empty text. Pages cut off in the middle are read to
their end. A host with one page has no template; on one with two,
what both share outside their articles is. Copies of a page don't make each other
constant. Repeated rows are extracted one by one. A null url counts as a host of its own.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reference pages of a group; pages of a host per group; what makes a host large (so at most 1000 hosts are).
REFERENCES, PER_GROUP, LARGE = 4, 2000, 4000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Tags by their part in a page.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre address summary legend option".split())
CONTAINERS = set(
    "html head body article main section div nav header footer aside form ul ol dl table thead tbody tfoot tr figure details dialog menu fieldset select button noscript template svg object video audio canvas center".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head nav footer aside form script style dialog menu select button noscript template svg object video audio canvas iframe fieldset".split())
#: Whole class, id or role names of what isn't content; parts of names (header-image, side-effects) say nothing.
_BOILER = re.compile(
    r"(?:(?:site|page|main|top|bottom|global|primary|secondary|left|right|blog|mobile|sticky)[-_]?)?(?:header|footer|nav|navbar|navigation|menu|sidebar|sidenav|banner|toolbar|topbar|masthead)|"
    r"(?:ad|ads|advert|adverts|advertisements?|adsense|advertising|sponsor(?:ed)?|promos?)(?:[-_]?(?:box|slot|unit|banner|container|wrapper|block|\d+))?|"
    r"(?:cookies?|consent|gdpr|privacy)(?:[-_]?(?:banner|bar|notice|consent|popup|overlay|message))?|"
    r"comments?(?:[-_]?(?:list|section|form|area|thread|wrapper|box))?|disqus(?:[-_]thread)?|repl(?:y|ies)|respond|"
    r"(?:share|sharing|social)(?:[-_]?(?:buttons?|bar|links?|icons?|media|share))?|(?:related|recommended|recommendations)(?:[-_]?(?:posts?|articles?|links?|stories|content|items))?|"
    r"(?:newsletter|subscribe|signup|login)(?:[-_]?(?:form|box|signup|banner|popup))?|search(?:[-_]?(?:form|box|bar))?|"
    r"notices?|alerts?|popup|modal|overlay|side|foot|widgets?|breadcrumbs?|pagination|pager|copyright|hidden|complementary|contentinfo",
    re.I,
)
#: What whole class or id names mark inside an article, where compound names may belong to its content.
_INSET = re.compile(
    r"(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo|promos|banner|cookies?|consent|notices?|popup|modal|comments?|comment-(?:list|section|form)|disqus|replies|respond|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|signup|login|search|pagination|pager|complementary|contentinfo)",
    re.I,
)
TEXT, PAGE = "#", "page"


def parse(html: str) -> list[list]:
    """Nodes in page order: [parent, tag, dropped, text, characters inside links]."""
    nodes: list[list] = [[-1, PAGE, False, "", 0]]
    path = [0]  # open containers
    block: int | None = None  # open block
    buffer: list[str] = []
    links = depth = 0

    def flush() -> None:
        nonlocal block, links
        if buffer:
            raw = "".join(buffer)
            buffer.clear()
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                if block is None:
                    nodes.append([path[-1], TEXT, False, text, links])
                else:
                    nodes[block][3] = text
                    nodes[block][4] = links
        block, links = None, 0

    def inset(path: list[int]) -> bool:
        return any(nodes[k][1] in ("article", "main") for k in path)

    def unfold(path: list[int]) -> None:
        """A form around an article or a page's heading holds the page, and isn't one of its forms."""
        for k in path:
            if nodes[k][1] == "form":
                nodes[k][2] = False

    def put(text: str) -> None:
        nonlocal links
        if text:
            buffer.append(text)
            if depth:
                links += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
        elif tag == "a":
            depth = max(0, depth + (-1 if closing else 1))
        elif tag == "br":
            put(" ")
        elif tag in BLOCKS:
            flush()
            depth = 0
            if not closing:
                if tag == "h1":
                    unfold(path)
                nodes.append([path[-1], tag, _boiler(m[3], inset(path)), "", 0])
                block = len(nodes) - 1
        elif tag in CONTAINERS:
            flush()
            depth = 0
            if closing:
                for k in range(len(path) - 1, 0, -1):
                    if nodes[path[k]][1] == tag:
                        del path[k:]
                        break
            else:
                if tag == "body":
                    while len(path) > 1 and nodes[path[-1]][1] == "head":
                        path.pop()
                kept = tag in ("html", "body", "article", "main")
                if tag in ("article", "main"):
                    unfold(path)
                nodes.append([path[-1], tag, tag in DROPPED or (not kept and _boiler(m[3], inset(path))), "", 0])
                path.append(len(nodes) - 1)
        elif tag in VOID:
            put(" ")
    flush()
    return nodes


def _boiler(attributes: str, inside: bool) -> bool:
    """Whether an element's marks call it something else than content; inside an article fewer names do."""
    if not attributes or attributes.isspace():
        return False
    for name, *values in _ATTR.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name in ("class", "id", "role") and any(map((_INSET if inside else _BOILER).fullmatch, value.split())):
            return True
    return False


class Tree:
    """A parsed page with its children lists, and the size and a hash of the tags of each subtree."""

    def __init__(self, nodes: list[list]):
        self.nodes = nodes
        self.children: list[list[int]] = [[] for _ in nodes]
        for i, node in enumerate(nodes[1:], 1):
            self.children[node[0]].append(i)
        self.chars = sum(len(node[3]) for node in nodes)
        self.size, self.shape = [1] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            self.size[i] += sum(self.size[k] for k in self.children[i])
            self.shape[i] = hash((nodes[i][1], *(self.shape[k] for k in self.children[i])))


class _Matching:
    """Weights of simple tree matching between two pages: the most nodes that two subtrees can have aligned in order."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.known = a, b, {}

    def ends(self, x: list[int], y: list[int]) -> tuple[int, int]:
        """How many subtrees at the start and at the end of two lists have the same shape; aligning these loses nothing."""
        p, q, least, k, e = self.a.shape, self.b.shape, min(len(x), len(y)), 0, 0
        while k < least and p[x[k]] == q[y[k]]:
            k += 1
        while e < least - k and p[x[-1 - e]] == q[y[-1 - e]]:
            e += 1
        return k, e

    def middle(self, i: int, j: int) -> tuple[list[int], list[int]]:
        x, y = self.a.children[i], self.b.children[j]
        k, e = self.ends(x, y)
        return x[k : len(x) - e], y[k : len(y) - e]

    def plain(self, i: int, j: int) -> int | None:
        """The weight where no lists have to be aligned for it, or where it is known."""
        if self.a.nodes[i][1] != self.b.nodes[j][1]:
            return 0
        if self.a.shape[i] == self.b.shape[j]:
            return self.a.size[i]
        if not self.a.children[i] or not self.b.children[j]:
            return 1
        return self.known.get((i, j))

    def learn(self, x: list[int], y: list[int]) -> None:
        """Weights of all pairs of two lists, deepest first."""
        open_ = [(i, j) for i in x if self.a.children[i] for j in y if self.plain(i, j) is None]
        while open_:
            i, j = open_[-1]
            if (i, j) in self.known:
                open_.pop()
                continue
            u, v = self.middle(i, j)
            more = [(k, m) for k in u if self.a.children[k] for m in v if self.plain(k, m) is None]
            if more:
                open_ += more
                continue
            first = self.a.children[i]
            k, e = self.ends(first, self.b.children[j])
            row = np.zeros(len(v) + 1, np.int64)
            for m in u if v else []:
                row = self.step(row, m, v)
            self.known[i, j] = 1 + sum(self.a.size[m] for m in first[:k] + first[len(first) - e :]) + int(row[-1])
            open_.pop()

    def step(self, row: np.ndarray, i: int, y: list[int]) -> np.ndarray:
        new = np.zeros_like(row)
        weights = np.fromiter((self.plain(i, j) for j in y), np.int64, len(y))
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights), out=new[1:])
        return new

    def aligned(self, x: list[int], y: list[int]) -> list[tuple[int, int]]:
        """The pairs of a best alignment. Every some rows of the program are kept and those between made again."""
        k, e = self.ends(x, y)
        out = list(zip(x[:k] + x[len(x) - e :], y[:k] + y[len(y) - e :], strict=True))
        x, y = x[k : len(x) - e], y[k : len(y) - e]
        if not x or not y:
            return out
        self.learn(x, y)
        every = isqrt(len(x)) + 1
        kept, row = [], np.zeros(len(y) + 1, np.int64)
        for i, node in enumerate(x):
            if i % every == 0:
                kept.append(row)
            row = self.step(row, node, y)
        i, j, at, rows = len(x), len(y), -1, []
        while i and j:
            if (i - 1) // every != at:
                at = (i - 1) // every
                rows = [kept[at]]
                for node in x[at * every : i]:
                    rows.append(self.step(rows[-1], node, y))
            here, above = rows[i - at * every], rows[i - at * every - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                out.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
        return out


def matched(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching from the roots down: pairs of nodes that are aligned in order."""
    weights, out, open_ = _Matching(a, b), [], [(0, 0)]
    while open_:
        i, j = open_.pop()
        out.append((i, j))
        if a.children[i] and b.children[j]:
            open_ += weights.aligned(a.children[i], b.children[j])
    return out


def _inside(nodes: list[list]) -> list[bool]:
    out = [False] * len(nodes)
    for i, (parent, tag, *_) in enumerate(nodes):
        out[i] = tag in ("article", "main") or (parent >= 0 and out[parent])
    return out


def template(tree: Tree, references: list[Tree]) -> set[int]:
    """Nodes whose text is constant over most references; pages without common slots and copies don't count.

    Two references have to agree. A host of two pages has one only; there what both share
    outside their articles is constant.
    """
    votes: dict[int, int] = {}
    used = 0
    for other in references:
        pairs = [(i, j) for i, j in matched(tree, other) if tree.nodes[i][3] and other.nodes[j][3]]
        same = [i for i, j in pairs if tree.nodes[i][3] == other.nodes[j][3]]
        if not pairs or 5 * sum(len(tree.nodes[i][3]) for i in same) >= 4 * tree.chars:
            continue
        used += 1
        for i in same:
            votes[i] = votes.get(i, 0) + 1
    if len(references) == 1:
        inside = _inside(tree.nodes)
        return {i for i in votes if not inside[i]}
    return {i for i, v in votes.items() if v > 1 and 2 * v > used}


def main_text(tree: Tree, constant: set[int]) -> str:
    """Blocks of the content in page order, one on each line."""
    nodes = tree.nodes
    dropped, inside = [False] * len(nodes), _inside(nodes)
    for i, (parent, tag, drop, _, _) in enumerate(nodes):
        dropped[i] = drop or (parent >= 0 and dropped[parent]) or (tag == "header" and not inside[i])
    texts = [i for i, node in enumerate(nodes) if node[3] and not dropped[i] and i not in constant]
    found = [i for i in texts if inside[i]]
    if not found:
        found = [i for i in texts if 2 * nodes[i][4] <= len(nodes[i][3])]
    return "\n".join(nodes[i][3] for i in found)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(5)
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            body = [zlib.compress(json.dumps(parse(x or ""), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1) for x in pages.slice(at, 256).to_pylist()]
            yield pa.record_batch([*part.columns[:5], pa.array(body, pa.binary())], ["page_id", "url", "host", "part", "draw", "body"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (host, part, draw); the first of a group are its references."""

    def done(waiting, references):
        return [(page, url, main_text(t, template(t, [r for r in references if r is not t]))) for page, url, t in waiting]

    now, references, waiting = None, [], []
    for batch in batches:
        out = []
        for page, url, host, part, _, body in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            tree = Tree(json.loads(zlib.decompress(body).decode("utf-8", "surrogatepass")))
            if (host, part) != now:
                out += done(waiting, references)
                now, references, waiting = (host, part), [], []
            waiting.append((page, url, tree))
            if len(references) < REFERENCES:
                references.append(tree)
            else:
                out += done(waiting, references)
                waiting = []
        yield _texts(out)
    yield _texts(done(waiting, references))


def _texts(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["page_id", "url", "text"])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = pages.select(_host(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = pages.select("url").count()
    large = {r.host: r.n for r in sizes.where(F.col("n") > max(LARGE, total // 1000)).collect()}  # at most 1000 hosts
    parts = F.lit(1).cast("long")
    if large:
        known = F.create_map(*(F.lit(x) for h, k in large.items() for x in (h, -(-k // PER_GROUP))))
        parts = F.coalesce(F.try_element_at(known, F.col("host")), F.lit(1)).cast("long")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("draw"), "html")
    keyed = keyed.select("page_id", "url", "host", F.pmod(F.shiftright("draw", 20), parts).alias("part"), "draw", "html")
    packed = keyed.mapInArrow(_packed, "page_id long, url string, host string, part long, draw long, body binary")
    grouped = packed.repartition(n, "host", "part").sortWithinPartitions("host", "part", "draw")
    return grouped.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
