"""Operator 1: benchmark decontamination.

The windows of the benchmark items form a broadcast set of 64-bit hashes of normalised n-grams. Every
document is scanned once: each of its word windows is hashed inside generated code and looked up, and only
where a hash is found are the words of both sides compared, so a hit is exact. One row per document and hit
then meets by document.

Defined results: null or empty text has no words and is never contaminated; a null item_id contaminates
but isn't listed; an item without words has no window; rows that repeat (same doc_id, same text) are
returned as often as they came; very long texts are scanned whole; extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SALTS, WORD, read, stored, text_hash, words


def _window(h: Column, at: Column, k: int) -> Column:
    """Hash of the k words from position `at`, counted from 0; h holds the words' hashes."""
    return F.xxhash64(*[F.get(h, at + i) for i in range(k)])


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(key, gram, bk, items): each different window, its hash, its length and the ids of the items that
    hold it, as strings. A window has n words, or all of an item that has fewer."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("bk", F.least(F.size("w"), F.lit(n)))
    at = items.select("item", "bk", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("bk"))).alias("at"))
    h = F.transform("w", lambda x: F.xxhash64(x))
    key = F.coalesce(*[F.when(F.col("bk") == k, _window(h, F.col("at"), k)) for k in range(1, n + 1)])
    grams = at.select("item", "bk", key.alias("key"), F.array_join(F.slice("w", F.col("at") + 1, F.col("bk")), " ").alias("gram"))
    return grams.groupBy("key", "gram", "bk").agg(F.collect_set("item").alias("items"))


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, broadcast_bytes: int, all_docs: bool) -> DataFrame:
    """(doc_id, text_hash, n, pos, k, items): a row per document and window that it shares with the benchmark;
    with all_docs also a row per row of docs with k = 0 and no items.

    The hash set is broadcast while its estimated size stays below broadcast_bytes; a larger one is
    joined by a shuffle on the hash, with both sides salted so that a common passage is split.
    """
    bench = benchmark_windows(benchmark, n)
    # At most n lengths and one size come to the driver.
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 32)
    found = bench.groupBy("bk").agg(F.sum(F.octet_length("gram") + ids + 64).alias("bytes")).collect()
    lengths, size = sorted(r["bk"] for r in found), sum(r["bytes"] for r in found)
    bench = bench.select("key", F.col("gram").alias("bgram"), F.col("bk").alias("k"), "items")

    scanned = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), words(F.col("text")).alias("w"))
    carried = all_docs and size <= broadcast_bytes
    if carried:
        # A row of its own carries every document through the join, at position -1.
        bench = bench.unionByName(benchmark.sparkSession.createDataFrame([(0, "", 0, [])], "key long, bgram string, k int, items array<string>"))
    scanned = scanned.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    shortest, own = (lengths[0] if lengths else n), -1 if carried else 0
    # Positions from which a window fits.
    places = F.sequence(F.lit(own), F.greatest(F.size("w") - shortest, F.lit(own)))
    rows = scanned.select("doc_id", "text_hash", "w", "h", F.explode(places).alias("at"))
    at, w = F.col("at"), F.col("w")

    def key(k: int) -> Column:
        return F.when(at < 0, F.lit(0 if k == shortest else None).cast("long")).otherwise(_window(F.col("h"), at, k))

    # No list is made for each position where all windows are of one length; what runs over the end fails the comparison of words.
    rows = rows.select("*", F.explode(F.array(*[key(k) for k in lengths])).alias("key")) if len(lengths) > 1 else rows.withColumn("key", key(shortest))
    keys = rows.drop("h")
    if size <= broadcast_bytes:
        gram = F.when(at >= 0, F.array_join(F.slice(w, at + 1, F.greatest("k", F.lit(1))), " ")).otherwise("")
        met = keys.join(F.broadcast(bench), "key").withColumn("n", F.size(w))
    else:
        # The n words from a position on travel with its hash, and of those as many are compared as the window has.
        ahead = F.when(at >= 0, F.array_join(F.slice(w, F.greatest(at, F.lit(0)) + 1, n), " ")).otherwise("")
        salt = F.pmod(F.xxhash64("doc_id", "text_hash", "at"), F.lit(SALTS)).cast("int")
        keys = keys.select("doc_id", "text_hash", F.size(w).alias("n"), "at", "key", salt.alias("salt"), ahead.alias("ahead"))
        gram = F.when(at >= 0, F.call_function("substring_index", F.col("ahead"), F.lit(" "), F.greatest("k", F.lit(1)))).otherwise("")
        met = keys.join(bench.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"])
    # Two prefix tests are an equality that the planner leaves out of the join's keys: words are compared only where hashes agree.
    same = F.startswith(F.col("bgram"), gram) & F.startswith(gram, F.col("bgram"))
    hits = met.filter(same).select("doc_id", "text_hash", "n", (at + 1).alias("pos"), "k", "items")
    if not all_docs or carried:
        return hits
    # No document goes through the shuffle of hashes only to be counted.
    none = F.array().cast("array<string>").alias("items")
    return hits.unionByName(scanned.select("doc_id", "text_hash", F.size("w").alias("n"), F.lit(0).alias("pos"), F.lit(0).alias("k"), none))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, items (sorted), spans (pos, k) and contaminated."""
    per_doc = _hits(docs, benchmark, n, broadcast_bytes, True).groupBy("doc_id", "text_hash").agg(
        F.max("n").cast("long").alias("n_words"),
        F.sum(F.when(F.col("k") == 0, 1)).cast("int").alias("rows"),
        F.array_sort(F.collect_set(F.when(F.col("k") > 0, F.struct("pos", "k")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    end = lambda x: x["pos"] + x["k"] - 1
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, x: F.struct(F.greatest(a["end"], end(x)).alias("end"), (a["total"] + F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["pos"] - 1))).alias("total")),
        lambda a: a["total"].cast("long"),
    )
    per_doc = per_doc.select("*", n_hit.alias("n_hit")).withColumn("contaminated", F.col("n_hit") > 0)
    return per_doc.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the documents that hold a benchmark window; all columns and clean rows stay as they are.

    The contaminated documents' names are written first; while few, they are broadcast, and no text is shuffled.
    """
    hit = _hits(docs, benchmark, n, broadcast_bytes, False).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hit = stored(hit, "contaminated")
    if hit.count() * 64 <= broadcast_bytes:
        hit = F.broadcast(hit)
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__id"]) & (text_hash(docs["text"]) == hit["__hash"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the words inside benchmark windows, and what follows each up to the next word, cut from text."""
    hit = contamination(docs, benchmark, n, broadcast_bytes).filter("contaminated")
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__hash"])
    joined = docs.join(hit, docs["doc_id"].eqNullSafe(hit["__id"]) & (text_hash(docs["text"]) == hit["__hash"]), "left")
    letters = r"0-9A-Za-z\x{80}-\x{10FFFF}"
    lead = F.regexp_extract("text", f"^[^{letters}]*", 0)
    pieces = F.regexp_extract_all("text", F.lit(f"[{letters}]+[^{letters}]*"), F.lit(0))
    cut = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["pos"], s["pos"] + s["k"] - 1))))
    kept = F.array_except(F.sequence(F.lit(1), F.size(pieces)), cut)
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(F.transform(kept, lambda i: F.element_at(pieces, i)), "")))
    return joined.withColumn("text", text).drop("__id", "__hash", "__spans")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram FROM bk),
ks AS (SELECT DISTINCT k FROM bg),
dg AS (SELECT row, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram
  FROM d, ks WHERE len(w) >= k),
hit AS (SELECT dg.row, dg.pos, dg.k, bg.item_id FROM dg JOIN bg ON dg.gram = bg.gram),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT row, pos, k FROM hit)) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
"""
