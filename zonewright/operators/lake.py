"""Snapshots, deltas and the state they lead to. All joins are on the name, never on the skewed ending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import zones as Z
from .candidates import few


def added(today: DataFrame, before: DataFrame, key: str = "name") -> DataFrame:
    return today.join(before.select(key), key, "left_anti")


def removed(today: DataFrame, before: DataFrame, key: str = "name") -> DataFrame:
    return before.join(today.select(key), key, "left_anti")


def snapshot_diff(today: DataFrame, before: DataFrame) -> DataFrame:
    """(name, tld, op): what was added and removed, from a single full outer join."""
    t, b = today.select("name", F.col("tld").alias("t")), before.select("name", F.col("tld").alias("b"))
    both = t.join(b, "name", "full_outer").filter(F.col("t").isNull() | F.col("b").isNull())
    return both.select("name", F.coalesce("t", "b").alias("tld"), F.when(F.col("b").isNull(), "added").otherwise("removed").alias("op"))


def lifecycle(today: DataFrame, state: DataFrame, day: Column) -> DataFrame:
    """The next state (name, tld, first_seen, last_seen, is_active): names that return keep their first day."""
    t = today.select("name", F.col("tld").alias("t_tld"), F.lit(True).alias("here"))
    j = t.join(state, "name", "full_outer")
    here = F.col("here").isNotNull()
    return j.select("name", F.coalesce("t_tld", "tld").alias("tld"), F.coalesce("first_seen", day).alias("first_seen"), F.when(here, day).otherwise(F.col("last_seen")).alias("last_seen"), here.alias("is_active"))


def load_delta(delta: DataFrame, target: DataFrame, day: Column) -> DataFrame:
    """Rows of the delta that the target doesn't have yet, with the day they came."""
    return delta.join(target.select("name", "tld"), ["name", "tld"], "left_anti").withColumn("added_day", day)


#: Added and removed names as a day's files hold them. The removal's day is text: not every writer gives a number.
ADDED_FILE, REMOVED_FILE = "name string, label string, tld string", "name string, removed_day string, tld string"


def load_delta_files(spark: SparkSession, added_path: str, removed_path: str, target: str, day: int) -> DataFrame:
    """Loads a day's Parquet files (folders tld=.../) into {target}/domain and {target}/domain_removed, and reports on each
    ending: (tld, added_loaded, removed_loaded, status, recovery_type).

    Added names are committed first and stay, whatever happens to the removed ones. A removal without a day is of `day`, and that is
    ok. Where any day of an ending is no number, all its removals are taken as of `day` (recovered). Where a file of an ending can't be
    read, or holds no row, none of its removals is loaded (partial): they are left to a later run. Other endings aren't held up.
    A repeated load replaces what it loaded of that day. No removed files at all is a day without removals.
    """
    fresh = spark.read.schema(ADDED_FILE).parquet(added_path).filter("name IS NOT NULL")
    Z.write_lake(fresh.withColumn("added_day", F.lit(day)), f"{target}/domain", "added_day", "tld")
    added = fresh.groupBy("tld").agg(F.count(F.lit(1)).alias("added_loaded"))
    if Z.exists(spark, removed_path):
        rows = spark.read.schema(REMOVED_FILE).option("ignoreCorruptFiles", "true").parquet(removed_path)
        number = F.expr("try_cast(removed_day AS int)")
        odd = F.col("removed_day").isNotNull() & number.isNull()
        read = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("name").alias("n"), F.max(odd).alias("odd"))
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(removed_path).select(F.col("_metadata.file_path").alias("path"))
        files = files.withColumn("tld", F.regexp_extract("path", "tld=([^/]+)/", 1)).join(read, "path", "left")
        state = files.groupBy("tld").agg(F.sum("n").alias("n"), F.max(F.col("n").isNull()).alias("lost"), F.max("odd").alias("odd"))
        state = Z.stored(state, "removed-state")
        loadable = rows.filter("name IS NOT NULL").join(few(state.filter("NOT lost").select("tld", "odd")), "tld")
        when = F.when(F.col("odd"), F.lit(day)).otherwise(F.coalesce(number, F.lit(day)))
        # The folder tells which day's files a row came with, so that a repeated load finds it.
        Z.write_lake(loadable.select("name", when.alias("removed_day"), F.lit(day).alias("loaded_day"), "tld"), f"{target}/domain_removed", "loaded_day", "tld")
    else:
        state = spark.createDataFrame([], "tld string, n long, lost boolean, odd boolean")
    both = added.join(state, "tld", "full_outer")
    removed_loaded = F.when(F.col("lost"), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)))
    status = F.when(F.col("lost"), "partial").when(F.col("odd"), "recovered").otherwise("ok")
    how = F.when(F.col("lost"), "removed_unrecoverable").when(F.col("odd"), "removed_sanitised_retry")
    return both.select("tld", F.coalesce("added_loaded", F.lit(0)).cast("long").alias("added_loaded"), removed_loaded.cast("long").alias("removed_loaded"), status.alias("status"), how.alias("recovery_type"))


def expire(matches: DataFrame, gone: DataFrame, back: DataFrame) -> DataFrame:
    """matches with expired_day: that of `gone` (name, removed_day) where they have none yet, and none for names in `back`."""
    earlier = F.col("expired_day") if "expired_day" in matches.columns else F.lit(None).cast("int")
    j = matches.join(gone.select("name", "removed_day"), "name", "left").join(back.select("name", F.lit(True).alias("__back")).distinct(), "name", "left")
    return j.withColumn("expired_day", F.when(F.col("__back").isNull(), F.coalesce(earlier, "removed_day"))).drop("removed_day", "__back")


def pending(expected: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return expected.join(done.select(*keys), list(keys), "left_anti")


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One whole row for each key, the first in the given order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def upsert_matches(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], guarded: list[str]) -> DataFrame:
    """old overwritten by new on keys. Columns in `keep` never change; those in `guarded` don't once a
    match is dismissed or a confirmed threat."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in new.columns if c not in keys], F.lit(True).alias("__new"))
    o = old.withColumn("__old", F.lit(True))
    j = o.join(n, keys, "full_outer")
    settled = F.coalesce(F.col("status").isin("dismissed", "confirmed_threat"), F.lit(False))

    def pick(c: str) -> Column:
        fresh = F.when(F.col("__new").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c))
        if c in keep:
            fresh = F.when(F.col("__old").isNotNull(), F.col(c)).otherwise(F.col(f"__{c}"))
        elif c in guarded:
            fresh = F.when(settled, F.col(c)).otherwise(fresh)
        return fresh.alias(c)

    return j.select(*keys, *[pick(c) for c in old.columns if c not in keys])
