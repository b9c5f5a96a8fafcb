"""Operator 2: line dedup.

Lines are counted by key in levelled runs: each run is a table of (key hash, documents), dealt into buckets by hash
and sorted inside each, one file a bucket. A batch of documents first merge-anti-joins the keys that the runs have
already settled as common, then adds its own counts as a run of level 0; when a level holds `fanout` runs they are
merged into one run of the next. Runs are summed and merged with each other bucket by bucket as they lie: they
are neither shuffled nor sorted again. They live in the shared folder, so lost executors cost only their
running tasks.

A key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased; its hash is the
128-bit md5. Texts are cut and hashed once, and read once more for the lines that stay. Defined results: null or
empty text is one empty line; every row counts as a document, also one that repeats another or shares its doc_id, or
has none; a text whose lines all go becomes empty; very long lines are keys like others; extra columns are carried
along untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SALTS, lower_ascii, read, shared_dir, stored, text_hash

BLANK = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def _hashed(text: Column, min_chars: int) -> Column:
    """The key hash of each line, null where the key is shorter than min_chars."""
    keys = F.transform(lines(text), line_key)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k))))


#: Makes Spark take the order of bucket files that hold one run each as given.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _ordered(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_ORDERED, "false")
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


class LineRuns:
    """The levelled runs; level i holds runs that i compactions have merged."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, root: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = root or shared_dir(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._name, self._made = f"line_runs_{uuid.uuid4().hex}", 0

    def _write(self, counts: DataFrame, level: int) -> None:
        table = f"{self._name}_{self._made}"
        self._made += 1
        # As many partitions as buckets, by the same hash: every bucket is one file.
        whole = counts.repartition(self.buckets, "h")
        with _ordered(self.spark):
            whole.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{table}").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            self._forget(old)

    def _forget(self, runs: list[str]) -> None:
        """Takes runs out of the session's catalogue."""
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")

    def close(self) -> None:
        self._forget(self.paths)
        self.levels = [[]]

    def _merged(self, runs: list[str]) -> DataFrame:
        """(h, n), summed over runs by merging them in pairs; no run is moved or sorted."""

        def pair(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(b.withColumnRenamed("n", "m").hint("merge"), "h", "full_outer").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(pair, [self.spark.table(run) for run in runs])

    @property
    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def common(self) -> DataFrame:
        """Hashes of the keys found in min_docs documents or more so far."""
        if not self.paths:
            return self.spark.createDataFrame([], "h binary")
        # All runs are dealt into the same buckets: what they hold of a key is summed where it lies.
        runs = reduce(DataFrame.union, [self.spark.table(run) for run in self.paths])
        return runs.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.min_docs).select("h")

    def add(self, docs: DataFrame, min_chars: int) -> None:
        """Counts a batch of documents, but for keys that are settled already."""
        self.add_hashed(docs.select(_hashed(F.col("text"), min_chars).alias("hs")))

    def add_hashed(self, hashed: DataFrame) -> None:
        """A batch that has its lines' key hashes in hs."""
        seen = hashed.select(F.explode(F.array_distinct("hs")).alias("h")).filter(F.col("h").isNotNull())
        counts = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        with _ordered(self.spark):
            if self.paths:
                settled = stored(self.common(), "settled-lines").withColumn("settled", F.lit(True))
                # As an outer join, since Spark would move an anti-join below the counting, and shuffle common lines uncounted.
                counts = counts.join(settled.hint("merge"), "h", "left").filter("settled IS NULL").select("h", "n")
            self._write(counts, 0)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text without the common lines).

    The documents enter the runs in `batches` parts. The final hash set is broadcast when its counted
    size is below broadcast_bytes; else a salted shuffle join splits common lines.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    hashed = stored(docs.select("doc_id", text_hash(F.col("text")).alias("hash"), _hashed(F.col("text"), min_chars).alias("hs")), "line-hashes")
    for b in range(batches):
        runs.add_hashed(hashed.filter(F.pmod("hash", F.lit(batches)) == b) if batches > 1 else hashed)
    with _ordered(spark):
        common = stored(runs.common(), "common-lines")
    runs.close()

    at = hashed.select("doc_id", "hash", F.posexplode("hs").alias("pos", "h")).filter(F.col("h").isNotNull())
    if common.count() * 64 <= broadcast_bytes:
        hits = at.join(F.broadcast(common), "h", "left_semi")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = at.withColumn("salt", F.pmod(F.xxhash64("doc_id", "hash", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left_semi")
    drop = hits.groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).agg(F.collect_set("pos").alias("__drop"))

    joined = docs.join(drop, docs["doc_id"].eqNullSafe(drop["__id"]) & (text_hash(docs["text"]) == drop["__hash"]), "left")
    all_lines = lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    return (
        joined.withColumn("n_lines", F.size(all_lines).cast("long"))
        .withColumn("n_dropped", F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long"))
        .withColumn("__lines", F.when(F.col("__drop").isNotNull(), all_lines))
        .withColumn("kept", F.when(F.col("__drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(kept))
        .drop("__id", "__hash", "__drop", "__lines")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH l AS (SELECT row, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT row, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
f AS (SELECT k.row, k.doc_id, k.i, k.line, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY row, doc_id
"""
