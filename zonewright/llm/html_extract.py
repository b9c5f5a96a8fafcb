"""Operator 12: the main text of web pages by wrapper induction.

Every page becomes a tree of its blocks. For each host the pages of least hash in REFERENCES classes of hashes are its
references; every page is aligned with each of them by simple tree matching (the greatest number of nodes that match
top-down in order, equal texts first), and the counts of nodes that hold the same text are added up over all pages of
the host. Nodes whose text is the same on at least half of the pages, SUPPORT at least, are the host's template and are
dropped wherever they are aligned; varying slots are content. A page that shares more than half of its text with a
reference is a copy of it and says nothing about what the template is.

What varies may still be a menu or an advert: elements that say so by name, role, class or id are left out. Where a page
marks its articles (or else its main part), only their blocks count; elsewhere blocks of links are left out too.

Pages are parsed and aligned once, beside their host's references: these are broadcast if few, else pages are dealt by host
and salt. What they leave is stored, and template nodes are taken out by built-in functions.

Defined results: a null or empty html gives an empty text; a page whose url is null or has no host is aligned with none.
Every row is answered, repeated rows and null ids too, and repeated rows count as often as they come. Line breaks are white space inside a
block. Character references are decoded once; a broken one stays as it is. Elements nested deeper than DEPTH become children of
the one at that depth. Bare `<` that begin no tag are text. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SALTS, read, stored

#: References of a host, and how many pages must share a text before it can be template.
REFERENCES, SUPPORT = 3, 8
#: Deeper elements are lifted, as browsers do; alignments of more cells are split in two.
DEPTH, CELLS = 200, 1 << 21
#: A slot is the number of a node within its reference, after the reference's number in the high bits.
NODE_BITS = 40

# Element names of HTML by what they are for.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
LEFT_OUT = set("head script style noscript template iframe object applet svg math canvas audio video map nav menu footer aside dialog form fieldset button select textarea datalist title xmp noembed noframes search".split())
# Start tags that close an open element: which they close, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}
# Words of classes, ids and roles that mark what isn't the article.
MARKS = set(
    """ad ads advert adverts advertisement advertising adsense adslot adbox banner banners sponsor sponsored promo promotion breadcrumb breadcrumbs cookie cookies consent gdpr
    comment comments commentlist discussion disqus reply replies respond footer footnav masthead menu menus menubar nav navbar navigation navigationbar contentinfo complementary
    modal popup overlay newsletter subscribe subscription signup login notice notices alert pager pagination related recommended recommendations search searchbox share sharing
    sharebar social sidebar sidebars sidenav skip skiplink toolbar topbar widget widgets""".split()
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block of a page, or a run of text in one (label "#")."""

    __slots__ = ("children", "label", "links", "shape", "text", "whole", "zone")

    def __init__(self, label: str, zone: int = 0):
        self.label, self.children, self.text, self.links, self.zone = label, [], "", 0, zone


class _Open:
    """An open element: the block that takes its text, and what it is inside of."""

    __slots__ = ("linked", "name", "node", "out", "zone")

    def __init__(self, name: str, node: Node, out: bool, zone: int, linked: bool):
        self.name, self.node, self.out, self.zone, self.linked = name, node, out, zone, linked


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw else {}


def _marked(name: str, attributes: dict[str, str], zone: int) -> bool:
    """Whether an element says that it isn't part of the article."""
    if name in LEFT_OUT or (name == "header" and not zone):
        return True
    if not attributes or name in ("body", "html", "article", "main") and not {"comment", "comments", "ad", "sponsored"} & set(_WORDS.findall(attributes.get("class", "").lower())):
        return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    said = {w.lower() for k in ("class", "id", "role") for w in _WORDS.findall(attributes.get(k, ""))}
    return not said.isdisjoint(MARKS) or ("header" in said and not zone)


def parse(page: str) -> Node:
    """The tree of blocks below the body; zone of a node: 2 inside an article, 1 inside a main part, else 0."""
    root = Node("body")
    stack = [_Open("", root, False, 0, False)]
    pieces: list[str] = []
    linked = 0
    at, quoted, last_end = 0, True, page.rfind(">")
    last = stack[0]

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                leaf = Node("#", pieces_zone)
                leaf.text, leaf.links = text, linked
                last_block.children.append(leaf)
            pieces.clear()
            linked = 0

    last_block, pieces_zone = root, 0

    def add(piece: str) -> None:
        nonlocal linked, last_block, pieces_zone
        if last.out or not piece:
            return
        if last.node is not last_block or last.zone != pieces_zone:
            flush()
            last_block, pieces_zone = last.node, last.zone
        if last.linked:
            linked += len(piece)
        pieces.append(piece)

    def shut(upto: int) -> None:
        """Closes the elements from that place of the stack on."""
        nonlocal last
        if any(o.name in BLOCKS for o in stack[upto:]):
            flush()
        del stack[upto:]
        last = stack[-1]

    while True:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if lt > last_end:
            # No tag ends any more.
            add(page[lt:])
            break
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            continue
        found = _TAG.match(page, lt) if quoted and (after.isalpha() or after == "/") else None
        if found is None and (after.isalpha() or after == "/"):
            found = _PLAIN_TAG.match(page, lt)
            # A quote that never ends: from here on quotes don't count, so that the rest isn't read again for each tag.
            quoted = quoted and found is None
        if found is None:
            add("<")
            at = lt + 1
            continue
        at = found.end()
        closing, name, raw = found.group(1), found.group(2).lower(), found.group(3)
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    shut(i)
                    break
                # An inline element doesn't close what is around its block.
                if name not in BLOCKS and stack[i].name in BLOCKS:
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            continue
        if name == "br":
            add("\n")
            continue
        block = name in BLOCKS
        if block:
            flush()
            # An open paragraph ends where a block begins.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    shut(i)
                    break
                if stack[i].name in BLOCKS:
                    break
            if name in CLOSES:
                ends, bound = CLOSES[name]
                upto = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in ends:
                        upto = i
                    elif stack[i].name in bound:
                        break
                if upto:
                    shut(upto)
        if name in VOID or raw.endswith("/") and name not in BLOCKS and name in ("path", "use", "circle"):
            continue
        attributes = _attributes(raw)
        zone = max(last.zone, 2 if name == "article" or attributes.get("itemprop") == "articleBody" else 1 if name == "main" or attributes.get("role") == "main" else 0)
        out = last.out or _marked(name, attributes, zone)
        node = last.node
        if block and not out and len(stack) <= DEPTH and name not in ("html", "body"):
            node = Node(f"{name}.{re.sub('[0-9]+', '', attributes.get('class', ''))}", zone)
            last.node.children.append(node)
        opened = _Open(name, node, out, zone, last.linked or name == "a")
        if len(stack) <= 4 * DEPTH:
            stack.append(opened)
            last = opened
    flush()
    return root


class Shapes:
    """Numbers for the shapes of subtrees, and how many nodes two shapes have in common when they are matched."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.sizes: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}

    def number(self, node: Node) -> None:
        for c in node.children:
            self.number(c)
        key = (node.label, *(c.shape for c in node.children))
        if key not in self.ids:
            self.ids[key] = len(self.parts)
            self.parts.append(key)
            self.sizes.append(1 + sum(self.sizes[c] for c in key[1:]))
        node.shape = self.ids[key]
        node.whole = hash((node.text, node.shape, *(c.whole for c in node.children)))

    def common(self, a: int, b: int) -> int:
        if a == b:
            return self.sizes[a]
        pa_, pb = self.parts[a], self.parts[b]
        if pa_[0] != pb[0]:
            return 0
        if len(pa_) == 1 or len(pb) == 1:
            return 1
        pair = (a, b)
        if pair not in self.memo:
            w = self.weights(np.array(pa_[1:]), np.array(pb[1:]))
            row = np.zeros(w.shape[1] + 1, np.int64)
            for line in w:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + line))
            self.memo[pair] = 1 + int(row[-1])
        return self.memo[pair]

    def weights(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        return np.array([[self.common(x, y) for y in ub.tolist()] for x in ua.tolist()], np.int64)[ia][:, ib]


class _Weights:
    """Weights between two lists of siblings: the nodes in common; equal subtrees outweigh whatever else could be matched."""

    def __init__(self, shapes: Shapes, a: list[Node], b: list[Node]):
        ua, self.ia = np.unique([x.shape for x in a], return_inverse=True)
        ub, self.ib = np.unique([x.shape for x in b], return_inverse=True)
        self.table = np.array([[shapes.common(x, y) for y in ub.tolist()] for x in ua.tolist()], np.int64)
        self.wa, self.wb = np.array([x.whole for x in a], np.int64), np.array([x.whole for x in b], np.int64)

    def line(self, i: int, low: int, high: int) -> np.ndarray:
        w = self.table[self.ia[i]][self.ib[low:high]]
        return w + (self.wb[low:high] == self.wa[i]) * (w << 24)


def _last_row(w: _Weights, rows: range, low: int, high: int, back: bool) -> np.ndarray:
    row = np.zeros(high - low + 1, np.int64)
    for i in rows:
        line = w.line(i, low, high)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (line[::-1] if back else line)))
    return row


def _aligned(w: _Weights, top: int, bottom: int, low: int, high: int) -> list[tuple[int, int]]:
    """Pairs (row, column), in order, of greatest total weight among these rows and columns."""
    n, m = bottom - top, high - low
    if not n or not m:
        return []
    if n * m > CELLS and n > 1:
        # Too many cells to keep: the place where the best way crosses the middle row, then both halves.
        half = (top + bottom) // 2
        cut = low + int(np.argmax(_last_row(w, range(top, half), low, high, False) + _last_row(w, range(bottom - 1, half - 1, -1), low, high, True)[::-1]))
        return _aligned(w, top, half, low, cut) + _aligned(w, half, bottom, cut, high)
    best = np.zeros((n + 1, m + 1), np.int64)
    lines = [w.line(top + i, low, high) for i in range(n)]
    for i, line in enumerate(lines):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + line))
    pairs, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((top + i, low + j))
    return pairs[::-1]


def match(shapes: Shapes, a: Node, b: Node, same: dict[int, Node]) -> None:
    """Notes for each text of a that its match in b holds too: id of the node in a to the node in b."""
    if a.label != b.label:
        return
    if a.label == "#":
        if a.text == b.text:
            same[id(a)] = b
        return
    x, y = a.children, b.children
    if len(x) == len(y) and [c.label for c in x] == [c.label for c in y] and len({c.label for c in x}) == len(x):
        pairs = [(i, i) for i in range(len(x))]
    else:
        pairs = _aligned(_Weights(shapes, x, y), 0, len(x), 0, len(y)) if x and y else []
    for i, j in pairs:
        match(shapes, x[i], y[j], same)


def texts(node: Node) -> list[Node]:
    """The texts of a tree in page order."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.label == "#":
            out.append(n)
        todo.extend(reversed(n.children))
    return out


def _main(leaves: list[Node]) -> list[Node]:
    """The texts of the articles; without articles those of the main part; without one all but blocks of links."""
    most = max((t.zone for t in leaves), default=0)
    return [t for t in leaves if t.zone == most] if most else [t for t in leaves if 2 * t.links <= len(t.text)]


_ALIGNED = "page_id long, url string, host string, texts array<string>, slots array<array<long>>, copies array<int>"


class _Host:
    """The references of a host as trees, and the shapes seen on its pages."""

    def __init__(self, host: str | None, references: list[tuple[int, str]]):
        self.host, self.references = host, references
        self._read()

    def _read(self) -> None:
        self.shapes, self.trees = Shapes(), []
        for number, page in self.references:
            tree = parse(page)
            self.shapes.number(tree)
            self.trees.append((number, tree, {id(t): k for k, t in enumerate(texts(tree))}))

    def align(self, page: str) -> tuple[list[str], list[list[int]], list[int]]:
        """The page's main texts; for each the slots that hold the same text; the references that it is a copy of."""
        tree = parse(page)
        main = _main(texts(tree))
        slots: list[list[int]] = [[] for _ in main]
        copies = []
        if self.trees and main:
            if len(self.shapes.parts) > 100_000:
                self._read()
            self.shapes.number(tree)
            for number, ref, places in self.trees:
                same: dict[int, Node] = {}
                match(self.shapes, tree, ref, same)
                for t, found in zip(main, slots, strict=True):
                    if id(t) in same:
                        found.append((number << NODE_BITS) | places[id(same[id(t)])])
                if 2 * sum(len(t.text) for t in main if id(t) in same) > sum(len(t.text) for t in main):
                    copies.append(number)
        return [t.text for t in main], slots, copies


def _aligner(known: Broadcast | None):
    """Rows come host by host; a host's references are known, or come as a row of their own before its pages."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Host(None, [])
        for batch in batches:
            here, columns = [], ([], [], [])
            for i in range(batch.num_rows):
                host = batch.column("host")[i].as_py()
                if batch.column("refs")[i].is_valid:
                    now = _Host(host, [(r["ref"], r["html"]) for r in batch.column("refs")[i].as_py()])
                    continue
                if host != now.host:
                    now = _Host(host, known.value.get(host, []) if known else [])
                here.append(i)
                for column, value in zip(columns, now.align(batch.column("html")[i].as_py() or ""), strict=True):
                    column.append(value)
            kinds = (pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int32()))
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(here, pa.int64())) for c in ("page_id", "url", "host")), *made], names=["page_id", "url", "host", "texts", "slots", "copies"])

    return align


def _aligned_pages(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows: page_id, url, host, html; refs: host, refs. References are broadcast if their bytes are few; else they are dealt
    to every salt of their host, and pages, which follow them, to one."""
    none = F.lit(None).cast(refs.schema["refs"].dataType)
    size = F.aggregate("refs", F.lit(64).cast("long"), lambda n, r: n + F.octet_length(r["html"]))
    if refs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n <= BROADCAST_BYTES:
        known = rows.sparkSession.sparkContext.broadcast({r.host: [(x.ref, x.html) for x in r.refs] for r in refs.collect()})
        return rows.withColumn("refs", none).sortWithinPartitions("host").mapInArrow(_aligner(known), _ALIGNED)
    place = F.xxhash64("page_id", "url")
    salt = F.when(F.col("host").isNull(), place).otherwise(F.pmod(place, F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    dealt = rows.withColumn("refs", none).withColumn("salt", salt).unionByName(refs.withColumn("salt", salts), allowMissingColumns=True)
    return dealt.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("refs").isNull()).drop("salt").mapInArrow(_aligner(None), _ALIGNED)


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, in lower case; else null."""
    host = F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)
    return F.when(F.length(host) > 0, F.lower(host))


def _beside(pages: DataFrame, few: DataFrame, size: Column, spread: Column) -> DataFrame:
    """pages with the columns that `few` has for their host: broadcast if its bytes are few, else by host and salt."""
    bytes_ = few.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    if bytes_ <= BROADCAST_BYTES:
        return pages.join(F.broadcast(few), "host", "left")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = pages.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("salt", F.explode(salts)), ["host", "salt"], "left").drop("salt")


def extracted(pages: DataFrame, support: int = SUPPORT, references: int = REFERENCES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    # Two narrow passes: the least hash of each class, then the pages that have it.
    hashed = rows.filter(F.col("host").isNotNull() & F.col("html").isNotNull()).withColumn("hash", F.xxhash64("html")).withColumn("ref", F.pmod("hash", F.lit(references)).cast("int"))
    least = hashed.groupBy("host", "ref").agg(F.min("hash").alias("hash"))
    chosen = _beside(hashed, least.groupBy("host").agg(F.collect_set("hash").alias("least")), F.lit(200), F.xxhash64("page_id", "url"))
    chosen = chosen.filter(F.array_contains("least", F.col("hash"))).groupBy("host", "ref").agg(F.min("html").alias("html"))
    refs = stored(chosen.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("ref", "html"))).alias("refs")), "html-references")
    aligned = stored(_aligned_pages(rows, refs), "html-aligned", compression="zstd")

    told = aligned.filter(F.col("host").isNotNull())
    number = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(references - 1)), "copies")).alias("ref")
    others = told.select("host", number).groupBy("host", "ref").agg(F.count(F.lit(1)).alias("pages"))
    ref = F.shiftright("slot", NODE_BITS).cast("int")
    held = told.filter(F.exists("slots", lambda s: F.size(s) > 0)).select("host", "copies", F.explode(F.array_distinct(F.flatten("slots"))).alias("slot")).withColumn("ref", ref)
    held = held.filter(~F.array_contains("copies", F.col("ref"))).groupBy("host", "ref", "slot").agg(F.count(F.lit(1)).alias("same"))
    template = held.join(others, ["host", "ref"]).filter((F.col("same") >= support) & (2 * F.col("same") >= F.col("pages")))
    nodes = stored(template.groupBy("host").agg(F.collect_set("slot").alias("template")), "html-template")
    left = F.filter(F.arrays_zip("texts", "slots"), lambda t: ~F.coalesce(F.arrays_overlap(t["slots"], F.col("template")), F.lit(False)))
    text = F.array_join(F.transform(left, lambda t: t["texts"]), "\n")
    out = _beside(aligned.select("page_id", "url", "host", "texts", "slots"), nodes, F.size("template") * 8 + 64, F.xxhash64("page_id", "url")).select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
