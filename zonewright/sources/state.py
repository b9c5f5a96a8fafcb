"""Tables of state that are kept from day to day, bucketed by name.

A kept table has `buckets` buckets by the hash of the name and `parts` partitions by another one. Joins on the name read the state as it
lies, without moving it; only what is joined to it is shuffled, into the same buckets. A change replaces the partitions that it touches,
by a dynamic overwrite whose tasks already hold one bucket each; the others aren't read or written.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import zones as Z

#: Partitions of a kept table.
PARTS = 16
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def part_of(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class Kept:
    """A kept table: its rows with `key`, which is never null, and a column __part."""

    def __init__(self, spark: SparkSession, table: str, key: str = "name", parts: int = PARTS):
        self.spark, self.table, self.key, self.parts = spark, table, key, parts

    @classmethod
    def create(cls, rows: DataFrame, name: str, key: str = "name", buckets: int | None = None, parts: int = PARTS) -> Kept:
        """Writes rows as a new table in the shared folder. buckets: the session's shuffle partitions unless given; fewer than those
        would make Spark shuffle the state again."""
        spark = rows.sparkSession
        path = Z.scratch(spark, name)
        table = "kept_" + re.sub("[^a-z0-9]+", "_", path.rsplit("/", 1)[-1].lower())
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # One task for each bucket, so that a bucket is one file in each partition.
        dealt = rows.withColumn("__part", part_of(F.col(key), parts)).repartition(n, key)
        dealt.write.format("parquet").option("path", path).partitionBy("__part").bucketBy(n, key).sortBy(key).saveAsTable(table)
        return cls(spark, table, key, parts)

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """The state; of the given partitions alone, if any are named."""
        rows = self.spark.table(self.table)
        if touched is not None:
            rows = rows.filter(F.col("__part").isin(*touched))
        return rows.drop("__part")

    def touched(self, changes: DataFrame) -> list[int]:
        """The partitions that the keys of changes lie in: at most `parts` numbers."""
        return sorted(r[0] for r in changes.select(part_of(F.col(self.key), self.parts)).distinct().collect())

    def replace(self, rows: DataFrame) -> None:
        """Overwrites the partitions that rows lie in. They may be computed from the table itself: its files change when all new ones are there."""
        columns = self.spark.table(self.table).columns
        before = self.spark.conf.get(_OVERWRITE, None)
        self.spark.conf.set(_OVERWRITE, "dynamic")
        try:
            rows.withColumn("__part", part_of(F.col(self.key), self.parts)).select(*columns).write.insertInto(self.table, overwrite=True)
        finally:
            self.spark.conf.unset(_OVERWRITE) if before is None else self.spark.conf.set(_OVERWRITE, before)
        self.spark.catalog.refreshTable(self.table)

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces what changes touch by merge(state, changes), which keeps at least one row of each partition; returns the partitions."""
        touched = self.touched(changes)
        if touched:
            self.replace(merge(self.read(touched), changes))
        return touched
