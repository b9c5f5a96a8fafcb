"""Reporting over ingestion runs: latest status, daily status, coverage and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["source", "tld"]


def ok(status: str = "status") -> Column:
    return F.col(status) == "success"


def latest(value: Column, when: Column, order: Column) -> Column:
    """The value of the row with the highest order among those that fulfil `when`."""
    return F.max_by(F.when(when, value), F.when(when, order))


def order_of(started: str = "started_at", tie: str = "id") -> Column:
    return F.struct(F.col(started), F.col(tie))


def run_facts(runs: DataFrame) -> DataFrame:
    """Per (source, tld) in one pass: last status, last success and last failure."""
    any_, o = F.lit(True), order_of()
    return runs.groupBy(*KEYS).agg(
        latest(F.col("status"), any_, o).alias("last_status"), F.max("started_at").alias("last_run"),
        F.max(F.when(ok(), F.col("started_at"))).alias("last_success"),
        F.max(F.when(F.col("status") == "failed", F.col("started_at"))).alias("last_failure"),
        latest(F.col("reason_code"), F.col("status") == "failed", o).alias("last_reason"),
    )


def daily_status(runs: DataFrame) -> DataFrame:
    """Per (source, tld, day): the best run of each phase, success first, then newest."""
    r = runs.withColumn("day", F.to_date("started_at"))
    w = Window.partitionBy(*KEYS, "day", "phase").orderBy(F.desc(ok()), F.desc("started_at"), F.desc("id"))
    best = r.withColumn("r", F.row_number().over(w)).filter("r = 1")
    of = lambda p: F.max(F.when(F.col("phase") == p, F.col("status")))
    return best.groupBy(*KEYS, "day").agg(of("full").alias("full_status"), of("r2").alias("r2_status"), of("pg").alias("pg_status"), F.sum("domains_inserted").alias("inserted"), F.sum("domains_deleted").alias("deleted"), F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_end"))


def z_scores(daily: DataFrame, keys: list[str], value: str, least_days: int = 3) -> DataFrame:
    """Days against their key's mean, in sample standard deviations."""
    stats = daily.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("days")).filter((F.col("days") >= least_days) & (F.col("sd") > 0))
    return daily.join(stats, keys).withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd"))


def heatmap(runs: DataFrame, keys: DataFrame, first: str, last: str) -> DataFrame:
    """Every key on every day; days without a run are pending, running ones count as such."""
    days = keys.select(*KEYS, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    rank = F.when(F.col("status") == "running", 3).when(ok(), 2).otherwise(1)
    seen = runs.groupBy(*KEYS, F.to_date("started_at").alias("day")).agg(F.max(rank).alias("r"))
    state = F.when(F.col("r") == 3, "running").when(F.col("r") == 2, "ok").when(F.col("r") == 1, "failed").otherwise("pending")
    return days.join(seen, [*KEYS, "day"], "left").select(*KEYS, "day", state.alias("state"))


def stale_runs(runs: DataFrame, policy: DataFrame, now: Column, default_seconds: int) -> DataFrame:
    """Running rows past their own timeout, or the default one."""
    j = runs.filter("status = 'running'").join(policy.select(*KEYS, "timeout"), KEYS, "left")
    return j.filter(F.timestamp_diff("SECOND", F.col("started_at"), now) > F.coalesce("timeout", F.lit(default_seconds)))


def trailing_count(rows: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """For each row how many rows of its keys came within the seconds before it, itself included."""
    sec = F.unix_timestamp(F.col(at).cast("timestamp"))
    return rows.withColumn("recent", F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(sec).rangeBetween(-seconds, 0)))


def newest_before(rows: DataFrame, keys: list[str], at: str, name: str, usable: Column, ttl: str) -> DataFrame:
    """rows with cached: the name of the newest other usable row of the same key at or before each, not older than ttl.

    One pass over each key in time order, whatever its rows: a request and its results are never paired. Of rows of the
    same time the one of highest name counts, or the next to it for that row itself.
    """
    own = Window.partitionBy(*keys, at)
    # Among rows of one time: the two highest usable names.
    tied = F.sort_array(F.collect_set(F.when(usable, F.col(name))).over(own), asc=False)
    best = F.when(F.get(tied, F.lit(0)) != F.col(name), F.get(tied, F.lit(0))).otherwise(F.get(tied, F.lit(1)))
    marked = rows.withColumns({"__same": best, "__last": F.when(usable, F.struct(F.col(at).alias("at"), F.col(name).alias("name")))})
    earlier = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "__last").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The last usable row of an earlier time: this time's own rows are skipped by taking what stood before the first of them.
    before = F.lag(earlier).over(Window.partitionBy(*keys).orderBy(at, "__last"))
    first = marked.withColumn("__before", before)
    first = first.withColumn("__before", F.first("__before").over(own.orderBy("__last").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fresh = F.when(F.col("__before.at") > F.col(at) - F.expr(f"INTERVAL {ttl}"), F.col("__before.name"))
    return first.withColumn("cached", F.coalesce("__same", fresh)).drop("__same", "__last", "__before")
