"""What reviewers do to matches, and which states are to be assessed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An action: a new status, or that the name is the company's own; notes and reviewer may be missing.
ACTION = "action_id long, match_id long, at timestamp, action string, status string, reviewer string, notes string, add_to_profile boolean"


def fold_actions(actions: DataFrame) -> DataFrame:
    """(match_id, status, self_owned, ownership, auto_disposition, reviewed_by, reviewed_at, notes): each match after all its actions, in order of time and id.

    The latest action says the status; one that marks the name as owned dismisses it, and what it says about ownership stays whatever follows.
    reviewed_by and reviewed_at change only where a reviewer is named, the time also where a name is marked as owned; notes where there are some.
    An action that comes again, known by its id, counts once.
    """
    owned = F.col("action") == "owned"
    a = actions.filter(owned | F.col("status").isNotNull()).dropDuplicates(["action_id"])
    o = F.struct("at", "action_id")
    latest = lambda value, when: F.max_by(F.when(when, value), F.when(when, o))
    named = ~owned & F.col("reviewer").isNotNull()
    folded = a.groupBy("match_id").agg(
        F.max_by(F.when(owned, "dismissed").otherwise(F.col("status")), o).alias("status"), F.bool_or(owned).alias("self_owned"), latest(F.col("reviewer"), named).alias("reviewed_by"),
        F.max(F.when(named | owned, F.col("at"))).alias("reviewed_at"), latest(F.col("notes"), ~owned & F.col("notes").isNotNull()).alias("notes"),
    )
    return folded.withColumns({"ownership": F.when(F.col("self_owned"), "confirmed_owned"), "auto_disposition": F.when(F.col("self_owned"), "self_owned")})


def confirmed_names(actions: DataFrame, matches: DataFrame) -> DataFrame:
    """(brand_id, name): names that reviewers have added to their brand's profile. matches: match_id, brand_id, name."""
    added = actions.filter((F.col("action") == "owned") & F.col("add_to_profile")).select("match_id").distinct()
    return matches.join(added, "match_id", "left_semi").select("brand_id", "name").distinct()


def needs_assessment(states: DataFrame, assessed: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """states (match_id, bucket, fingerprint and more) with `again`: the fingerprint differs from the one that the last assessment saw, there is none, or the state it saw
    is older than days. Matches of the watchlist never are. assessed: match_id, seen (its fingerprint), derived_at."""
    j = states.join(assessed.select("match_id", "seen", "derived_at"), "match_id", "left")
    old = F.col("derived_at") < now - F.make_dt_interval(days=F.lit(days))
    again = F.col("bucket").isin("immediate_attention", "defensive_gap") & (F.col("seen").isNull() | (F.col("seen") != F.col("fingerprint")) | F.coalesce(old, F.lit(False)))
    return j.withColumn("again", again).drop("seen", "derived_at")
