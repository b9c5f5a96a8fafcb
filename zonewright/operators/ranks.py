"""Numbering rows of large groups without sorting a group in one task, and what it is used for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import zones as Z


def distributed_rank(rows: DataFrame, groups: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """rows with their place, from 1, in each group by the order, which should be total.

    Rows are dealt into ranges of (group, order), however large a group is; ranges are counted, and a range's rows are numbered from
    the sum of those before it in their group. The ranges are stored, so that counting and numbering see the same ones.
    """
    keys = [F.col(g).asc_nulls_first() for g in groups]
    ranges = Z.stored(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counted = ranges.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__n"))
    # One narrow row for each group and range.
    before = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__before"))
    placed = ranges.withColumn("__place", F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(*order)))
    same = F.col("__range") == F.col("__r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return placed.join(offsets, same).withColumn(rank, F.col("__before") + F.col("__place")).select(*rows.columns, rank)


def budget_rank(matches: DataFrame, limit: int, today: Column, stale_days: int = 7) -> DataFrame:
    """matches with budget_rank: 1..n for a brand's matches that need attention at once, however many; then up to `limit` the others, by tier: new
    today, defensive gaps, promising ones of the watchlist, those not enriched for days. Null beyond, and for matches that are settled.

    matches: brand_id, name, attention_bucket, score_final, actionability_score, disposition, auto_disposition (or null), first_detected and last_enriched (dates).
    """
    active = (F.coalesce("auto_disposition", F.lit("")) == "") & (F.coalesce("disposition", F.lit("")) != "dismissed")
    now = F.col("attention_bucket") == "immediate_attention"
    tier = (
        F.when(~active, 9)
        .when(now, 0)
        .when(F.col("first_detected") == today, 1)
        .when(F.col("attention_bucket") == "defensive_gap", 2)
        .when((F.col("attention_bucket") == "watchlist") & (F.col("score_final") > 0.55), 3)
        .when(F.col("last_enriched").isNull() | (F.col("last_enriched") < F.date_sub(today, stale_days)), 4)
        .otherwise(5)
    )
    ranked = distributed_rank(matches.withColumn("__tier", tier), ["brand_id"], [F.col("__tier").asc(), F.desc_nulls_last("actionability_score"), F.desc("score_final"), F.col("name").asc()], "__rank")
    # Those that need attention at once come first, so the others' places already follow theirs; settled ones come last.
    return ranked.withColumn("budget_rank", F.when((F.col("__tier") == 0) | ((F.col("__tier") < 9) & (F.col("__rank") <= limit)), F.col("__rank")).cast("long")).drop("__tier", "__rank")
