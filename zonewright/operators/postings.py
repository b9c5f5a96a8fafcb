"""An inverted index of trigrams that is kept from day to day, for finding the names like some seeds without reading all names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from . import candidates as C

#: Folders that the trigrams of a day are dealt to.
SHARDS = 64
_POSTING = "name string, tld string, label string, added_day int, size int, place int, g string"


def _shard(g: Column) -> Column:
    return F.pmod(F.xxhash64(g), F.lit(SHARDS)).cast("int")


class Postings:
    """Posting lists of the prefixes of names, in a folder.

    The order of trigrams, rare ones first, is fixed when the index is made: counts of the first names, by slot, then the trigram itself. Of a name's n trigrams the
    first n - least * n + 1 are posted, which is enough for every similarity from `least` on. A day's names are a folder of their own, dealt by
    trigram and sorted by it, so that a search opens the folders of its own trigrams and skips what lies between; a day that is added again replaces
    itself. Names that are gone are noted by day and left out of what was posted until then.
    """

    def __init__(self, spark: SparkSession, path: str, least: float):
        self.spark, self.path, self.least = spark, path, least
        counts = {r.slot: r.n for r in spark.read.schema("slot int, n long").parquet(f"{path}/order").collect()}
        self.rarity = F.split(F.lit(",".join(str(min(counts.get(i, 0), 2**31 - 1)) for i in range(C.SLOTS))), ",").cast("array<int>")

    @classmethod
    def create(cls, names: DataFrame, path: str, least: float = 0.3) -> Postings:
        """An empty index whose order comes from names; at most SLOTS counts."""
        grams = names.select(F.explode(L.trigrams(F.col("label"))).alias("g"))
        grams.groupBy(C._slot(F.col("g")).alias("slot")).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/order")
        return cls(names.sparkSession, path, least)

    def _prefix(self, x: Column, t: Column) -> Column:
        """(size, place, g) of the first trigrams of a text."""
        ranked = lambda gs: F.array_sort(F.transform(gs, lambda g: F.struct(F.get(self.rarity, C._slot(g)).alias("n"), g.alias("g"))))
        first = lambda gs: F.slice(ranked(gs), 1, (F.size(gs) - F.ceil(F.size(gs) * t - 1e-9) + 1).cast("int"))
        rows = lambda gs: F.transform(first(gs), lambda r, i: F.struct(F.size(gs).alias("size"), (i + 1).cast("int").alias("place"), r["g"].alias("g")))
        return F.inline(L.once(L.trigrams(x), rows))

    def add(self, names: DataFrame, day: int) -> None:
        """Posts the names that came on that day."""
        rows = names.select("name", "tld", "label", "added_day", self._prefix(F.col("label"), F.lit(self.least))).withColumn("shard", _shard(F.col("g")))
        # A frequent trigram's list is dealt on by name.
        dealt = rows.repartition("shard", F.pmod(F.xxhash64("name"), F.lit(4))).sortWithinPartitions("shard", "g")
        dealt.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/postings/day={day}")

    def remove(self, names: DataFrame, day: int) -> None:
        """Notes the names that were gone on that day."""
        names.select("name").write.mode("overwrite").parquet(f"{self.path}/gone/day={day}")

    def _gone(self) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gone")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema("name string, day int").parquet(f"{self.path}/gone") if fs.exists(p) else None

    def candidates(self, seeds: DataFrame, threshold: Column | None = None) -> DataFrame:
        """Pairs (name, tld, label, added_day, seed_value, sim) as of trigram_candidates; thresholds below `least` raise."""
        t = threshold if threshold is not None else L.trigram_threshold(F.col("seed_value"))
        s = seeds.select("seed_value").distinct().select("seed_value", t.cast("double").alias("t"))
        s = s.select("seed_value", "t", self._prefix(F.col("seed_value"), F.col("t"))).toDF("seed_value", "t", "n2", "p2", "g")
        asked = s.agg(F.min("t").alias("t"), F.collect_set(_shard(F.col("g"))).alias("shards")).first()
        if asked.t is not None and asked.t < self.least:
            raise ValueError(f"the index holds similarities from {self.least} on")
        rows = self.spark.read.schema(f"{_POSTING}, day int, shard int").parquet(f"{self.path}/postings").filter(F.col("shard").isin(*asked.shards) if asked.shards else F.lit(False))
        pairs = C._by_trigram(rows, s)
        left = 1 + F.least(F.col("size") - F.col("place"), F.col("n2") - F.col("p2"))
        fits = (F.least("size", "n2") >= F.col("t") * F.greatest("size", "n2")) & (left * (1 + F.col("t")) >= F.col("t") * (F.col("size") + F.col("n2")) - 1e-9)
        kept = ["name", "tld", "label", "added_day", "seed_value", "t"]
        pairs = pairs.filter(fits).select(*kept, "day").distinct()
        gone = self._gone()
        if gone is not None:
            last = gone.groupBy(F.col("name").alias("__name")).agg(F.max("day").alias("__gone"))
            pairs = pairs.join(last, (F.col("name") == F.col("__name")) & (F.col("__gone") >= F.col("day")), "left_anti")
        pairs = pairs.select(*kept).distinct().withColumn("sim", L.trigram_similarity(F.col("label"), F.col("seed_value")))
        return pairs.filter("sim >= t").select("name", "tld", "label", "added_day", "seed_value", "sim")

