"""Operator 9: n-gram Jaccard join by a MinHash LSH forest.

Texts are sets of word 5-grams; those with equal sets are one class from the start. A signature holds
`TREES` trees of `DEPTH` one-byte minima. In every tree the signatures form a prefix trie, which is worked through
as sorted rows: a node is a run of rows that share a prefix. Rows alone below the shortest prefix that the target
recall can ask for drop out first. Each remaining subtree is walked from its full depth: runs are compared, then the
matched prefix is shortened by one, and only pairs that meet there for the first time are compared. A subtree is
done when the chance that a pair as unlike as the least similar one found in it (the threshold at least) meets in
some tree at this depth reaches the target recall; where nothing was found, the shortest prefix is reached. The target is
one for isolated pairs: a very near copy beside a document can hide its partners at the threshold (measured: 0.997 with five of them). Compared
means whole signatures: pairs whose agreement could come from the threshold, six standard errors below it, are
candidates, and only a spanning forest of them is handed on. Each connected set of candidates then gathers
its 5-gram sets once, in blocks, and all its pairs are verified exactly there: every link is counted and
none is listed, so large groups of near copies cost no quadratic output.

Every set of a group meets every other in one block or in a pair of blocks; there is no cap on partners.
Classes are the connected components of the verified links.

Defined results: a text of one to four words is one n-gram of all its words; null or empty text has none,
links to nothing and is a class of its own; equal sets are one class without counting as links; class_id
is the smallest doc_id of the class, nulls last; repeated rows are returned as often as they came; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, read, stored, text_hash, word_hashes

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 32, 8
#: Sets of a group that are verified together, and the n-grams they may hold.
BLOCK, BLOCK_GRAMS = 1024, 1 << 21
#: Rows of one prefix that are compared with each other in one go.
PREFIX_BLOCK = 2048
#: A node with more edges than this, and than a thousandth of all, is a hub: there are a thousand at most.
HUB = 1000

_ODD_32 = np.random.default_rng(9).integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD_32 = np.random.default_rng(10).integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def met(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """The chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that still meets the target recall at the threshold: none is shortened beyond it."""
    while depth > 1 and met(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _gram_sets(h: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different 64-bit n-gram hashes of all texts in a row, and where each text ends."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - starts
    grams = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(ends)), grams)
    first = np.repeat(starts - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    last = np.repeat(ends, grams) - 1
    value = np.zeros(len(first), np.uint64)
    for k in range(n):
        at = first + k
        # Behind a short text's last word stands nothing.
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(at <= last, h[np.minimum(at, last)], np.uint64(k + 1)))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep], np.cumsum(np.bincount(text[keep], minlength=len(ends)))


def _signatures(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, TREES * DEPTH) bytes; texts without n-grams have zeros."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.zeros((len(ends), TREES * DEPTH), np.uint8)
    some = np.flatnonzero(ends > starts)
    if len(some):
        low, at = (value >> np.uint64(32)).astype(np.uint32), starts[some]
        buffer = np.empty_like(low)
        for k in range(TREES * DEPTH):
            np.multiply(low, _ODD_32[k], out=buffer)
            np.add(buffer, _ADD_32[k], out=buffer)
            least = np.minimum.reduceat(buffer, at)
            # The minimum's high bits are nearly always zero: a byte of its hash tells minima apart.
            out[some, k] = (least * np.uint32(2654435761)) >> np.uint32(24)
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = np.asarray(column.offsets, np.int64)[1:] - column.offsets[0].as_py()
    return np.asarray(column.flatten(), np.int64).view(np.uint64), ends


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component under the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, hash, sid, grams, sig): sid names the n-gram set, null for texts without any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                value, ends = _gram_sets(*_flat(batch.column("h")), n)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sig = _signatures(value, ends)
                # Two independent sums over the set make a 128-bit name.
                total = np.zeros((2, len(value) + 1), np.uint64)
                np.cumsum(_mix(value), out=total[0, 1:])
                np.cumsum(_mix(value ^ np.uint64(0xD6E8FEB86659FD93)), out=total[1, 1:])
                names = np.ascontiguousarray((total[:, ends] - total[:, starts]).T)
                some = ends > starts
                sid = pa.array([names[i].tobytes() if some[i] else None for i in range(len(ends))], pa.binary())
                sigs = pa.array([sig[i].tobytes() if some[i] else None for i in range(len(ends))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), sid, pa.array(ends - starts, pa.int64()), sigs], names=["doc_id", "hash", "sid", "grams", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("hash"), word_hashes(F.col("text")).alias("h"))
    return rows.mapInArrow(work, "doc_id long, hash long, sid binary, grams long, sig binary")


def _candidates(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges (a, b) of sids that span all pairs that meet in a trie and whose signatures agree enough."""
    shortest = prefix_depth(threshold, recall)
    m = TREES * DEPTH
    least = int(np.ceil(m * (threshold - 6 * np.sqrt(threshold * (1 - threshold) / m))))
    prefix = lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * DEPTH + 1, F.lit(shortest)))
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), prefix)
    # One narrow row for each set and tree; only those that share the shortest prefix get their signature back.
    rows = sets.select("sid", prefixes.alias("p")).select("sid", F.posexplode("p").alias("tree", "prefix"))
    counted = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("members"))
    # Rows of common prefixes, of which there are a thousand at most, stay where they are.
    limit = max(HUB, -(-sets.count() * TREES // 1000))
    hot = counted.filter(F.col("members") > limit).select("prefix", F.col("members").alias("hot"))
    tagged = rows.join(F.broadcast(hot), "prefix", "left")
    rest = tagged.filter("hot IS NULL").drop("hot").join(counted.filter(F.col("members").between(2, limit)), "prefix")
    known = rest.unionByName(tagged.filter("hot IS NOT NULL").withColumnRenamed("hot", "members"))
    shared = known.join(sets, "sid")
    # A subtree with many members is cut into blocks, and every pair of its blocks meets.
    blocks = F.ceil(F.col("members") / F.lit(PREFIX_BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    shared = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    branch = F.substring(F.col("sig"), F.col("tree") * DEPTH + 1, F.lit(DEPTH))
    shared = shared.select("sid", "sig", "prefix", "own", branch.alias("branch"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = shared.repartition("prefix", "i", "j").sortWithinPartitions("prefix", "i", "j", "branch", "sid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, ["prefix", "i", "j"]):
            n, sid = len(table["sid"]), table["sid"]
            sig = np.frombuffer(b"".join(table["sig"]), np.uint8).reshape(n, m)
            branch = np.frombuffer(b"".join(table["branch"]), np.uint8).reshape(n, DEPTH)
            own = np.where(np.array(table["i"]) == np.array(table["j"]), -1, np.array(table["own"]))
            a, b = _walk(sig, branch, table["__group"], own, shortest, threshold, recall, least)
            if len(a):
                root = _roots(n, a, b)
                kept = np.flatnonzero(root != np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array([sid[i] for i in root[kept]], pa.binary()), pa.array([sid[i] for i in kept], pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def _walk(sig: np.ndarray, branch: np.ndarray, subtree: np.ndarray, own: np.ndarray, shortest: int, threshold: float, recall: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in `least` bytes or more, from the deepest nodes of each subtree to the shortest prefix.

    Rows come sorted by subtree and branch. own: block of a row where only pairs across blocks count, else -1.
    """
    n, m = sig.shape
    new = np.ones(n, bool)
    new[1:] = subtree[1:] != subtree[:-1]
    number = np.cumsum(new) - 1
    same = np.zeros(n, np.int64)  # how many bytes a row shares with the one before
    same[1:] = np.cumprod(branch[1:] == branch[:-1], axis=1).sum(1)
    node = lambda depth: np.cumsum(new | (same < depth))
    active, lowest = np.ones(number[-1] + 1, bool), np.ones(number[-1] + 1)
    found_a, found_b, deeper = [], [], np.arange(n)
    for depth in range(branch.shape[1], shortest - 1, -1):
        now = node(depth)
        ends = np.searchsorted(now, now, side="right")
        some = np.flatnonzero(active[number])
        for lag in range(1, int((ends - np.arange(n))[some].max(initial=1))):
            at = some[some + lag < ends[some]]
            at = at[(deeper[at] != deeper[at + lag]) & ((own[at] < 0) | (own[at] != own[at + lag]))]
            for part in np.array_split(at, max(1, len(at) // 20_000)):
                agree = (sig[part] == sig[part + lag]).sum(1)
                ok = part[agree >= least]
                np.minimum.at(lowest, number[ok], agree[agree >= least] / m)
                found_a.append(ok)
                found_b.append(ok + lag)
        deeper = now
        hit = np.zeros(len(active), bool)
        hit[number[np.concatenate(found_a)] if found_a else []] = True
        active &= ~(hit & (met(np.maximum(lowest, threshold), depth) >= recall))
        if not active.any():
            break
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, int), np.zeros(0, int))


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 4096) -> Iterator[dict]:
    """Rows sorted by keys, cut only between groups: tables of `most` rows or one larger group.

    Yields the columns as lists, lists of numbers as (all numbers, how many each has), with __group numbering the groups.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def table(t: pa.Table, new: np.ndarray) -> dict:
        def plain(c: str) -> list | tuple[np.ndarray, np.ndarray]:
            column = t.column(c)
            if not pa.types.is_list(column.type):
                return column.to_pylist()
            # Never as Python numbers, which take five times the memory.
            return np.asarray(pc.list_flatten(column).combine_chunks(), np.int64), np.asarray(pc.list_value_length(column), np.int64)

        return {c: plain(c) for c in t.column_names} | {"__group": np.cumsum(new)}

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            c = c.dictionary_encode().indices if pa.types.is_binary(c.type) else c
            v = np.asarray(c)
            new[1:] |= v[1:] != v[:-1]
        return new

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held)
        new = starts(t)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield table(t.slice(0, cut), new[:cut])
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        t = pa.Table.from_batches(held)
        yield table(t, starts(t))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every connected component, for nodes with an edge.

    Each round joins every node's larger neighbours to its smallest one, then every node's smaller ones;
    both only regroup edges, whose number never grows, until all are stars.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = mark(now)
    while True:
        # Large star: all larger neighbours of a node point to the smallest of it and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * before["n"]).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        low = _with_least(stored(large, "edges"), before["n"])
        small = low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = stored(small, "edges")
        after = mark(now)
        if before == after:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """(u, v, m): the n edges with the smallest v of each u. Edges of hubs stay where they are, and the hubs' rows,
    a thousand at most, are broadcast; all others meet by u."""
    degrees = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    limit = max(HUB, -(-n // 1000))
    hubs = degrees.filter(F.col("n") > limit).select("u", F.col("m").alias("hub"))
    tagged = edges.join(F.broadcast(hubs), "u", "left")
    rest = tagged.filter("hub IS NULL").select("u", "v").join(degrees.filter(F.col("n") <= limit).select("u", "m"), "u")
    return rest.select("u", "v", "m").unionByName(tagged.filter("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")))


def _verified(docs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(sid, links, root, whole): the links of each set within its blocks, and the smallest set it is
    joined to there. members: sid, group, doc_id, hash, grams (one document for each set)."""
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum("grams").alias("total"))
    blocks = F.greatest(F.ceil(F.col("sets") / F.lit(BLOCK)), F.ceil(F.col("total") / F.lit(BLOCK_GRAMS)), F.lit(1)).cast("int")
    placed = members.join(sizes.select("group", blocks.alias("blocks")), "group")
    text = docs.select(F.col("doc_id").alias("__id"), text_hash(F.col("text")).alias("__hash"), "text")
    placed = F.broadcast(placed) if members.count() * 96 <= BROADCAST_BYTES else placed
    joined = text.join(placed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).dropDuplicates(["sid"])
    rows = joined.select("sid", "group", "blocks", word_hashes(F.col("text")).alias("h"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sid", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "blocks", "h")
    dealt = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "sid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, ["group", "i", "j"], 256):
            words, size = table["h"]
            value, ends = _gram_sets(np.ascontiguousarray(words).view(np.uint64), np.cumsum(size), n)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            bounds = np.flatnonzero(np.diff(table["__group"], prepend=0, append=-1))
            sid, links, roots, whole = [], [], [], []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                own = np.array(table["own"][lo:hi])
                # In a pair of two blocks only links across count; each block is also a pair with itself.
                across = table["i"][lo] != table["j"][lo]
                count, root = _links(value[starts[lo] : ends[hi - 1]], (ends - starts)[lo:hi], own if across else None, threshold)
                sid += table["sid"][lo:hi]
                links += count.tolist()
                roots += [table["sid"][lo + r] for r in root]
                whole += [b == 1 for b in table["blocks"][lo:hi]]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary()), pa.array(whole, pa.bool_())], names=["sid", "links", "root", "whole"])

    return dealt.mapInArrow(verify, "sid binary, links long, root binary, whole boolean")


def _links(value: np.ndarray, size: np.ndarray, block: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of each set, and its component's smallest member; value holds the sets in a row."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    gram, column = np.unique(value, return_inverse=True)
    times = np.bincount(column)
    everywhere = int((times == n).sum())
    live = (times > 1) & (times < n)
    number = np.cumsum(live) - 1
    keep = live[column]
    row, col = owner[keep], number[column[keep]]
    width = int(live.sum())
    common = np.full((n, n), everywhere, np.float32)
    step = max(1, min(4096, (1 << 24) // n))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, width, step):
        a, b = np.searchsorted(col, [at, at + step])
        part = np.zeros((n, min(step, width - at)), np.float32)
        part[row[a:b], col[a:b] - at] = 1
        common += part @ part.T
    # Exact in integers: c / (x + y - c) >= t.
    parts = round(threshold * 1000)
    c = common.astype(np.int64)
    ok = c * 1000 >= parts * (size[:, None] + size[None, :] - c)
    np.fill_diagonal(ok, False)
    if block is not None:
        ok &= block[:, None] != block[None, :]
    return ok.sum(1), _roots(n, *np.nonzero(ok))


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id, hash (of the text), class_id (the class's smallest doc_id), class_key (doc_id
    and hash of the document that stands for the class), n_links (other n-gram sets it is linked to)."""
    prints = stored(fingerprints(docs, n), "prints")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("hash"))
    sets = stored(prints.filter(F.col("sid").isNotNull()).groupBy("sid").agg(F.min(key).alias("key"), F.first("sig").alias("sig"), F.first("grams").alias("grams")), "sets")
    groups = components(_candidates(sets.select("sid", "sig"), threshold, recall))
    members = sets.join(groups, sets["sid"] == groups["node"]).select("sid", F.col("root").alias("group"), "key.doc_id", "key.hash", "grams")
    found = stored(_verified(docs, members, n, threshold), "links")

    links = found.groupBy("sid").agg(F.sum("links").alias("n_links"))
    within = found.filter("whole").select("sid", "root")
    edges = found.filter("not whole").filter("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
    if not edges.isEmpty():
        merged = components(edges)
        split = found.filter("not whole").select("sid").distinct().join(merged, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("root"))
        within = within.unionByName(split)
    else:
        within = within.unionByName(found.filter("not whole").select("sid", F.col("sid").alias("root")).distinct())
    placed = sets.select("sid", "key").join(within, "sid", "left").join(links, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "key", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = placed.groupBy("root").agg(F.min("key").alias("class_key"))
    classes = placed.join(names, "root").select("sid", "class_key", "n_links")
    alone = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("hash"))
    return prints.select("doc_id", "hash", "sid").join(classes, "sid", "left").select(
        "doc_id", "hash", F.coalesce(F.col("class_key"), alone).alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    ).select("doc_id", "hash", F.col("class_key.doc_id").alias("class_id"), "class_key", "n_links")


def one_of_each_class(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class, the one with the smallest doc_id; all columns stay.

    Texts without words have no class and all stay, but for repeated rows.
    """
    classes = jaccard_classes(docs, n, threshold, recall)
    stay = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_key.doc_id")) & (F.col("hash") == F.col("class_key.hash"))).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    keyed = docs.withColumn("__h", text_hash(F.col("text")))
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["__id"]) & (keyed["__h"] == stay["__hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__h"]).drop("__h")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM d),
u AS (SELECT min(doc_id) AS sid, s FROM g WHERE len(s) > 0 GROUP BY s),
e AS (SELECT sid, len(s) AS n, unnest(s) AS gram FROM u),
c AS (SELECT a.sid AS a, b.sid AS b FROM e a JOIN e b ON a.gram = b.gram AND a.sid <> b.sid GROUP BY a.sid, b.sid HAVING count(*) * 10 >= 8 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT sid, sid FROM u UNION SELECT r.a, c.b FROM reach r JOIN c ON r.b = c.a),
cls AS (SELECT a AS sid, min(b) AS class_id FROM reach GROUP BY a),
lk AS (SELECT a AS sid, count(*) AS n FROM c GROUP BY a)
SELECT g.doc_id, coalesce(cls.class_id, g.doc_id) AS class_id, CAST(coalesce(lk.n, 0) AS BIGINT) AS n_links
FROM g LEFT JOIN u ON g.s = u.s LEFT JOIN cls ON cls.sid = u.sid LEFT JOIN lk ON lk.sid = u.sid
"""
