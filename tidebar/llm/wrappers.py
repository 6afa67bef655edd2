"""Main text of web pages by wrapper induction.

Pages of a host share templates. One page of each host, the shortest, is the reference; every page's DOM tree is aligned with it by simple tree
matching, which prefers equal text among matchings of equal size. For each reference node, a slot, the values that pages say there are counted
over all pages: a value that pages of different articles share is constant. A slot whose pages mostly say constant values is template, whether
there is one value or a variant for each section of the site; the others vary. The content root is the deepest node that holds nearly all text
that varies. A page's text is what its node at the content root says, without template; the names of elements and classes only break ties
there: an article inside the root is the root, and what varies but is never content (comments, adverts, forms and the like) is left out. Inside an
article only one value that the host's own articles nearly all have is template, as groups of near copies share paragraphs.
With names=False the names of elements and classes say nothing but what a browser shows, and the wrapper alone decides.

Hosts whose trees are alike help each other. A slot's path is the tags and places from the root down to it. A value counts as shared if an article of
any host says it at the same path, where a host's own name stands for all hosts; and what the slots of the other hosts at that path are weighs as
much as PRIOR articles of the host itself. So a host of two pages is told by those like it, and a large one by itself, without a switch.

Copies and near copies of an article say nothing about the template. A page's article is known by the least hash of any 32 bytes of its content,
which near copies are likely to share, and a value counts once for each article.
Where neither a host nor those like it tell (no slot is template), names of elements and classes are all there is, and decide.

A host that a third of all pages share is split: its pages are salted by their bytes, and its reference is sent to each part.

Edge cases: a null or empty html, or one without text, gives an empty text; a url without host puts the page into the host ''; rows that repeat
give the same text; broken or unclosed markup is closed as browsers close it, roughly; nesting has no bound; an empty table gives an empty result;
columns other than key and url are not returned, whatever their names are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, stored, table

#: Bytes of html that one task gets of a host together, on average.
BYTES_PER_PART = 1_000_000
#: A slot is template if this share of articles has a value there that another article has too; articles that the slots of other hosts at the path
#: count for, and as many that tell for content where those are few.
SHARED, PRIOR = 0.5, 10
#: A slot has one constant value if this share of articles has it; only that value is template then. Else all that the slot says is, but headings
#: that vary are no template: near copies share their titles.
CONSTANT = 0.8
#: Share of the text that varies which a node must hold for the content root to lie in it.
ROOT_SHARE = 0.9
#: Bytes in a row that a page's article is known by (a power of two), and odd numbers that mix their hashes.
WINDOW, MIX = 32, (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
#: What a matched pair of nodes weighs beside one of equal texts.
PAIR = 1 << 20

#: Elements without an end tag; elements that begin a block; elements that are never content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noscript object option script select style "
    "svg template textarea title video".split()
)
#: Elements whose text no browser shows as text of the page.
SILENT = frozenset("audio canvas datalist embed head iframe map noscript object option script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Words of class and id that mark what is not content, and roles that do.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination popup promo "
    "promotion recommended related reply replies respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
    "taboola toolbar topbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Which open elements a start tag closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements that stop the search for an open element to close.
SCOPES = frozenset("article aside body div footer form header main nav ol section table td th ul dl blockquote".split())

WORDS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: The least hash of nothing.
NONE = 1 << 62


class Node:
    """An element; children are nodes and strings. For blocks, below are the nearest blocks inside; size, digest and least (of the hashes of WINDOW
    bytes) are those of what it says itself."""

    __slots__ = ("tag", "children", "marked", "heading", "role", "below", "said", "digest", "least", "size", "number")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]] = ()):
        self.tag, self.children, self.below, self.said, self.digest, self.least, self.size, self.number = tag, [], [], b"", 0, NONE, 0, 0
        values = dict(attributes)
        self.role = (values.get("role") or "").lower()
        names = CAMEL.sub(" ", f"{values.get('class') or ''} {values.get('id') or ''}").lower()
        found = MARKS.intersection(WORDS.findall(names))
        self.marked = bool(found) or self.role in ROLES
        self.heading = found == {"header"} and self.role not in ROLES

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.count: Counter = Counter()

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag)
        if shut:
            self._close_until(shut)
        elif tag in BLOCKS and self.count["p"]:
            self._close_until({"p"})
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in VOID or self.open[-1].tag != tag:
            return
        if tag not in BLOCKS:  # a slash means nothing to browsers, but svg and the like use it
            self._close_from(len(self.open) - 1)

    def _close_from(self, i: int) -> None:
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def _close_until(self, tags: set[str]) -> None:
        if any(self.count[t] for t in tags):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in tags:
                    return self._close_from(i)
                if self.open[i].tag in SCOPES:
                    return

    def handle_endtag(self, tag):
        if self.count[tag]:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    return self._close_from(i)
                if tag not in BLOCKS and self.open[i].tag in BLOCKS:
                    return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree_of(html: str | None, host: str | None = None) -> tuple[Node, list[Node]]:
    """The root and all blocks in page order, the root first; inline elements are part of their block. Digests are alike for all names of the host."""
    name = (host or "").encode("utf-8", "surrogatepass")
    builder = _Builder()
    if html:
        builder.feed(html)
        builder.close()
    root = builder.root
    nodes, said, waiting = [root], [[]], [(iter(root.children), root)]
    while waiting:
        children, owner = waiting[-1]
        for c in children:
            if isinstance(c, str):
                said[owner.number].append(c)
            elif c.tag in BLOCKS:
                said[owner.number].append(" ")
                c.number = len(nodes)
                nodes.append(c)
                said.append([])
                owner.below.append(c)
                waiting.append((iter(c.children), c))
                break
            elif c.tag == "br":
                said[owner.number].append(" ")
            elif c.tag not in NEVER:
                waiting.append((iter(c.children), owner))
                break
        else:
            waiting.pop()
    for node, parts in zip(nodes, said):
        text = " ".join("".join(parts).split())
        node.said = text.encode("utf-8", "surrogatepass")
        node.size, node.digest = len(text), xxhash.xxh3_64_intdigest(node.said.replace(name, b"\0") if name else node.said) >> 1
    return root, nodes


def least_hashes(said: list[bytes]) -> np.ndarray:
    """For each text the least hash of WINDOW bytes that begin in it; windows run on into the next texts. Built by doubling."""
    sizes = np.fromiter(map(len, said), dtype=np.int64, count=len(said))
    h = np.frombuffer(b"".join(said) + bytes(WINDOW), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    span, power = 1, int(MIX[0])
    while span < WINDOW:
        h = h[:-span] * np.uint64(power) + h[span:]
        power = power * power % (1 << 64)
        span *= 2
    h = ((h ^ (h >> np.uint64(29))) * MIX[1]) >> np.uint64(2)
    out = np.full(len(said), NONE, dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.minimum.reduceat(h[: sizes.sum()].astype(np.int64), (np.cumsum(sizes) - sizes)[full])
    return out


def never_content(node: Node, in_article: bool, names: bool = True) -> bool:
    """An article's own header holds its title; other headers are the page's."""
    if not names:
        return node.tag in SILENT
    if node.tag in NEVER or node.tag == "header" and not in_article:
        return True
    if not node.marked or node.tag in ("html", "body", "main") or in_article and node.heading:
        return False
    return node.tag != "article" or in_article


def content_of(root: Node, names: bool = True) -> set[int]:
    """Numbers of the blocks whose text can be part of the page's text, by their names."""
    found = articles(root) if names else []
    out, waiting = set(), [(n, True) for n in found or [root]]
    while waiting:
        node, block = waiting.pop()
        if block:
            out.add(node.number)
        waiting.extend((c, c.tag in BLOCKS) for c in node.elements() if not never_content(c, bool(found), names))
    return out


def skeleton(root: Node, nodes: list[Node], names: bool = True) -> bytes:
    """Tags, parents, and sizes, digests and least hashes of what the nodes say, in page order; sizes of what never is content are negative."""
    parent = np.zeros(len(nodes), dtype="<i4")
    for n in nodes:
        for c in n.below:
            parent[c.number] = n.number
    content = content_of(root, names)
    sizes = np.array([n.size if n.number in content else -n.size for n in nodes], dtype="<i4")
    digests = np.array([n.digest for n in nodes], dtype="<i8")
    least = least_hashes([n.said for n in nodes]).astype("<i8")
    return b"".join((len(nodes).to_bytes(4, "little"), parent.tobytes(), sizes.tobytes(), digests.tobytes(), least.tobytes(), " ".join(n.tag for n in nodes).encode("utf-8", "surrogatepass")))


def nodes_from(made: bytes) -> list[Node]:
    """The nodes of a skeleton, linked, in page order."""
    n = int.from_bytes(made[:4], "little")
    parents, sizes = (np.frombuffer(made, dtype="<i4", count=n, offset=4 + 4 * n * i).tolist() for i in (0, 1))
    digests, least = (np.frombuffer(made, dtype="<i8", count=n, offset=4 + 8 * n + 8 * n * i).tolist() for i in (0, 1))
    nodes = [Node(t) for t in made[4 + 24 * n :].decode("utf-8", "surrogatepass").split(" ")]
    for i, (node, up) in enumerate(zip(nodes, parents)):
        node.number, node.size, node.digest, node.least = i, sizes[i], digests[i], least[i]
        if i:
            nodes[up].below.append(node)
    return nodes


def paths(nodes: list[Node]) -> list[int]:
    """For each node a digest of the tags from the root down to it, and of its places among neighbours of its tag."""
    out = [0] * len(nodes)
    for n in nodes:  # parents come before their children
        before: Counter = Counter()
        for c in n.below:
            out[c.number] = xxhash.xxh3_64_intdigest(f"{out[n.number]} {c.tag} {before[c.tag]}".encode("utf-8", "surrogatepass")) >> 1
            before[c.tag] += 1
    return out


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of the largest simple tree matching, equal tags, order and parents kept; of the largest ones, one of most equal texts.

    For pairs of nodes under paired parents, a dynamic program over both lists of children gives the weight; children come before their parents.
    """
    if a.tag != b.tag:
        return []
    tables: dict[tuple[int, int], list[list[int]]] = {}
    weights: dict[tuple[int, int], int] = {}
    waiting = [(a, b, False)]
    while waiting:
        x, y, ready = waiting.pop()
        own = PAIR + (x.digest == y.digest and x.size != 0)
        if not (x.below and y.below):
            weights[x.number, y.number] = own
            continue
        if not ready:
            waiting.append((x, y, True))
            waiting.extend((p, q, False) for p in x.below for q in y.below if p.tag == q.tag)
            continue
        before = [0] * (len(y.below) + 1)
        rows = [before]
        for p in x.below:
            now = [0] * (len(y.below) + 1)
            for j, q in enumerate(y.below):
                best = before[j + 1] if before[j + 1] > now[j] else now[j]
                if p.tag == q.tag and (both := before[j] + weights[p.number, q.number]) > best:
                    best = both
                now[j + 1] = best
            rows.append(now)
            before = now
        tables[x.number, y.number] = rows
        weights[x.number, y.number] = own + before[-1]
    pairs, waiting = [], [(a, b)]
    while waiting:
        x, y = waiting.pop()
        pairs.append((x, y))
        if (x.number, y.number) not in tables:
            continue
        rows, i, j = tables[x.number, y.number], len(x.below), len(y.below)
        while i and j:
            if rows[i][j] == rows[i][j - 1]:
                j -= 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                waiting.append((x.below[i - 1], y.below[j - 1]))
                i, j = i - 1, j - 1
    return pairs


def compared(reference: list[Node], page: list[Node]) -> tuple[int, list[tuple[int, int, int, int]]]:
    """What the page's article is known by, and for each reference node with a partner its number, the digest of what the partner says, and sizes of
    content, the partner's own and all inside it. Blocks that say the same as their partners don't make an article known, unless all do."""
    inside = [max(n.size, 0) for n in page]
    for n in reversed(page):  # children come after their parents
        for c in n.below:
            inside[n.number] += inside[c.number]
    pairs = match(reference[0], page[0])
    same = {b.number for a, b in pairs if a.digest == b.digest}
    content = [n for n in page if n.size > 0] or page
    article = min((n.least for n in content if n.number not in same), default=None) or min(n.least for n in content)
    return article, [(a.number, b.digest if b.size else 0, max(b.size, 0), inside[b.number]) for a, b in pairs]


def articles(root: Node) -> list[Node]:
    """The outermost article elements, else the main ones, that are in no part that never is content.

    Where all are in marked parts, the marks speak of the page's layout, and the articles there count.
    """
    found: dict[tuple[str, bool], list[Node]] = {}
    waiting = [(root, False, False)]
    while waiting:
        node, in_main, marked = waiting.pop()
        if node.tag == "article":
            found.setdefault(("article", marked or node.marked), []).append(node)
            continue
        main = node.tag == "main" or node.role == "main"
        if main and not in_main:
            found.setdefault(("main", marked), []).append(node)
        if node.tag not in NEVER:
            waiting.extend((c, in_main or main, marked or (node.marked and not main)) for c in reversed(node.elements()))
    for kind in (("article", False), ("main", False), ("article", True), ("main", True)):
        if kind in found:
            return found[kind]
    return []


def article_text(root: Node, template: set[int], top: Node | None = None, names: bool = True) -> str:
    """The blocks under top (the page's content root; the whole page if None) that are not template, in page order. template: numbers of nodes.

    Where there is an article or main element, only what is inside counts.
    """
    found = articles(top or root) if names else []
    in_article = bool(found) or top is not None and top.tag not in ("#root", "html", "body")
    blocks: list[list[str]] = []
    for start in found or [top or root]:
        blocks.append([])
        waiting = [(iter(start.children), start.number in template, True)]  # children, whether their block is template, whether they are a block's
        while waiting:
            children, quiet, _ = waiting[-1]
            for c in children:
                if isinstance(c, str):
                    if not quiet:
                        blocks[-1].append(c)
                elif c.tag == "br":
                    blocks[-1].append(" ")
                elif not never_content(c, in_article, names):
                    block = c.tag in BLOCKS
                    if block:
                        blocks.append([])
                    waiting.append((iter(c.children), c.number in template if block else quiet, block))
                    break
            else:
                if waiting.pop()[2]:
                    blocks.append([])
    texts = (" ".join("".join(parts).split()) for parts in blocks)
    return "\n\n".join(t for t in texts if t)


class Wrapper:
    """A host's reference with what was induced: of template slots the constant value, or None if all values are template; the content root, or None."""

    def __init__(self, made: bytes, slots: list[dict], host: str | None = None, names: bool = True):
        self.nodes, self.host, self.names = nodes_from(made), host, names
        self.template: dict[int, int | None] = {}
        within = {n.number for n in self.nodes if n.tag in ("article", "main")} if names else set()
        for n in self.nodes:  # parents come before their children
            if n.number in within:
                within.update(c.number for c in n.below)
        for slot in slots:
            if slot["share"] >= SHARED:
                constant = slot["most"] >= CONSTANT * slot["articles"]
                if slot["node"] in within and not (constant and slot["most"] >= SHARED * (slot["articles"] + PRIOR)):
                    continue
                if not constant and self.nodes[slot["node"]].tag in HEADINGS:
                    continue
                self.template[slot["node"]] = slot["value"] if constant else None
                if constant:
                    self.nodes[slot["node"]].digest = slot["value"]  # which the reference itself may lack
        self.root = self._root({s["node"]: s for s in slots}) if self.template else None

    def _root(self, slots: dict[int, dict]) -> int | None:
        """Down from the page's root, as long as one child that holds blocks has nearly all text that varies, and no heading is left behind."""
        varies = [slots[n.number]["inside"] if n.number in slots else 0 for n in self.nodes]
        gone = [slots[n.number]["own"] if n.number in self.template else 0 for n in self.nodes]
        for n in reversed(self.nodes):
            for c in n.below:
                gone[n.number] += gone[c.number]
        varies = [max(0, v - g) for v, g in zip(varies, gone)]
        at = self.nodes[0]
        if not varies[0]:
            return None
        while True:
            inner = [c for c in at.below if varies[c.number] >= ROOT_SHARE * varies[at.number] and 2 * slots[c.number]["own"] < slots[c.number]["inside"]]
            titled = any(c.tag in HEADINGS and varies[c.number] and c not in inner for c in at.below)
            if not inner or titled or at.tag in ("article", "main"):
                return at.number
            at = inner[0]

    def text(self, html: str | None) -> str:
        root, _ = tree_of(html, self.host)
        if self.root is None:
            return article_text(root, set(), names=self.names)
        pairs = match(self.nodes[0], root)
        gone = {b.number for a, b in pairs if a.number in self.template and self.template[a.number] in (None, b.digest)}
        return article_text(root, gone, next((b for a, b in pairs if a.number == self.root), None), self.names)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def skeletons(pages: DataFrame, html: str, url: str, key: str, names: bool = True) -> DataFrame:
    """host, page, skeleton and bytes of the html of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hosts, texts = (batch.column(i).to_pylist() for i in (0, 2))
            made = [skeleton(*tree_of(t, h), names) for h, t in zip(hosts, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), batch.column(3)], names=["host", "page", "skeleton", "bytes"])

    schema = f"host string, page {pages.schema[key].dataType.simpleString()}, skeleton binary, bytes long"
    size = F.coalesce(F.octet_length(html), F.lit(0)).cast("long")
    return pages.select(host_of(F.col(url)).alias("host"), F.col(key).alias("page"), F.col(html).alias("html"), size.alias("bytes")).mapInArrow(run, schema)


def part_of(parts: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64("page"), parts), F.lit(0)).cast("int")


def in_parts(rows: DataFrame) -> DataFrame:
    """All rows of a part in one partition, the reference (role 0) first."""
    return rows.repartition("host", "part").sortWithinPartitions("host", "part", "role")


def aligned(rows: DataFrame) -> DataFrame:
    """host, node, path, value, article, own and inside: what a page says at each reference node with a partner, summed over the pages of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference: list[Node] = []
        path: list[int] = []
        for batch in slices(batches):
            found: dict[tuple, list[int]] = {}
            for host, role, made in zip(*(batch.column(c).to_pylist() for c in ("host", "role", "skeleton"))):
                nodes = nodes_from(made)
                if role == 0:
                    reference, path = nodes, paths(nodes)
                    continue
                article, said = compared(reference, nodes)
                for node, value, own, inside in said:
                    sums = found.setdefault((host, node, path[node], value, article), [0, 0])
                    sums[0] += own
                    sums[1] += inside
            keys = list(zip(*found)) or [()] * 5
            sums = list(zip(*found.values())) or [()] * 2
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, kinds)), *(pa.array(x, pa.int64()) for x in sums)], names=["host", "node", "path", "value", "article", "own", "inside"])

    return rows.select("host", "role", "skeleton").mapInArrow(run, "host string, node int, path long, value long, article long, own long, inside long")


def induce(made: DataFrame) -> DataFrame:
    """host, parts, skeleton (of the reference) and slots (for each of its nodes what pages say there), from skeletons (host, page, skeleton, bytes)."""
    shortest = F.min_by("skeleton", F.struct(F.length("skeleton"), "skeleton"))
    parts = F.ceil((F.sum("bytes") + 1) / BYTES_PER_PART).cast("int")
    hosts = stored(made.groupBy("host").agg(parts.alias("parts"), shortest.alias("skeleton")), "hosts")
    references = hosts.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "skeleton")
    dealt = made.join(hosts.where("parts > 1").select("host", "parts"), "host", "left").select("host", part_of(F.col("parts")).alias("part"), F.lit(1).alias("role"), "skeleton")
    said = aligned(in_parts(references.union(dealt)))
    # an article counts once for a value, then values for a slot; each step adds up in the tasks first
    by_article = said.groupBy("host", "node", "path", "value", "article").agg(F.sum("own").alias("own"), F.sum("inside").alias("inside"))
    values = stored(by_article.groupBy("host", "node", "path", "value").agg(
        F.count("*").alias("articles"), F.min("article").alias("first"), F.max("article").alias("last"), F.sum("own").alias("own"), F.sum("inside").alias("inside")), "values")
    says = F.col("value") != 0
    common = values.where(says).groupBy("path", "value").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").select("path", "value", F.lit(True).alias("common"))
    slots = stored(values.drop("first", "last").join(common, ["path", "value"], "left").groupBy("host", "node", "path").agg(
        F.sum("articles").alias("articles"), F.sum(F.when(F.col("common"), F.col("articles")).otherwise(0)).alias("shared"),
        F.max(F.when(says, F.col("articles")).otherwise(0)).alias("most"), F.max_by("value", F.struct(F.when(says, F.col("articles")), "value")).alias("value"),
        F.sum("own").alias("own"), F.sum("inside").alias("inside")), "slots")
    released(values)
    # what the other hosts' slots at the path tell counts as PRIOR articles, and they themselves begin with as many that tell for content
    alike = slots.groupBy("path").agg(F.sum("articles").alias("n"), F.sum("shared").alias("s"))
    others = (F.col("s") - F.col("shared")) / (F.col("n") - F.col("articles") + PRIOR)
    told = slots.join(alike, "path").withColumn("share", (F.col("shared") + PRIOR * others) / (F.col("articles") + PRIOR))
    told = told.groupBy("host").agg(F.collect_list(F.struct("node", "articles", "share", "most", "value", "own", "inside")).alias("slots"))
    out = stored(hosts.join(told, "host", "left"), "wrappers")
    released(slots, hosts)
    return out


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", names: bool = True) -> DataFrame:
    """key, url and text of every page. Pages are shuffled once, to meet their host's wrapper. Without names the wrapper alone decides."""
    kind = pages.schema[key].dataType.simpleString()
    made = stored(skeletons(pages, html, url, key, names), "skeletons")
    wrappers = induce(made)
    released(made)
    none = F.lit(None)
    first = wrappers.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), none.cast(kind).alias("page"), none.cast("string").alias("at"), none.cast("string").alias("html"), "skeleton", "slots")
    named = pages.select(host_of(F.col(url)).alias("host"), F.col(key).alias("page"), F.col(url).alias("at"), F.col(html).alias("html"))
    # hosts of more than one part: a row for each BYTES_PER_PART of html at most; Spark broadcasts them while they are small
    dealt = named.join(wrappers.where("parts > 1").select("host", "parts"), "host", "left").select(
        "host", part_of(F.col("parts")).alias("part"), F.lit(1).alias("role"), "page", "at", "html", none.cast("binary").alias("skeleton"), none.cast(wrappers.schema["slots"].dataType).alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = None
        for batch in slices(batches):
            page, at, text = [], [], []
            for host, role, p, u, h, made, slots in zip(*(batch.column(c).to_pylist() for c in ("host", "role", "page", "at", "html", "skeleton", "slots"))):
                if role == 0:
                    wrapper = Wrapper(made, slots or [], host, names)
                    continue
                page.append(p)
                at.append(u)
                text.append(wrapper.text(h))
            yield pa.RecordBatch.from_arrays([pa.array(page, batch.schema.field("page").type), pa.array(at, pa.string()), pa.array(text, pa.string())], names=["page", "at", "text"])

    found = in_parts(first.union(dealt)).mapInArrow(run, f"page {kind}, at string, text string")
    return found.select(F.col("page").alias(key), F.col("at").alias(url), "text")


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op5."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_wrapper_induction": op5_wrapper_induction}
