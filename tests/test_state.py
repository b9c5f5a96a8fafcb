"""State kept in buckets: plans without an exchange of the state, and only touched partitions are rewritten."""

import contextlib
import io

from pyspark.sql import functions as F

from zonewright.operators import lake as O
from zonewright.sources.state import Kept, part_of


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def state_of(spark, n=3000):
    return spark.range(n).select(F.concat("id", F.lit(".com")).alias("name"), F.lit("com").alias("tld"), F.lit("2024-01-01").cast("date").alias("first_seen"), F.lit("2024-01-30").cast("date").alias("last_seen"), F.lit(True).alias("is_active"))


def test_joins_move_only_what_is_new(spark):
    kept = Kept.create(state_of(spark), "lifecycle")
    today = spark.range(10, 3100).select(F.concat("id", F.lit(".com")).alias("name"), F.lit("com").alias("tld")).repartition(3)
    for df in (O.lifecycle(today, kept.read(), F.current_date()), O.snapshot_diff(today, kept.read()), O.added(today, kept.read())):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert "Bucketed: true" in plan
    assert O.lifecycle(today, kept.read(), F.current_date()).filter("is_active").count() == 3090


def test_only_touched_partitions_are_read_and_rewritten(spark):
    old = spark.range(2000).select(F.concat("id", F.lit(".com")).alias("name"), F.lit("new").alias("status"), F.lit(1).alias("score"), F.lit(0).alias("bucket"))
    kept = Kept.create(old, "matches", parts=32)
    files = lambda: {r[0] for r in spark.table(kept.table).select(F.input_file_name()).distinct().collect()}
    before = files()
    changes = spark.createDataFrame([("5.com", "x", 9, 9), ("fresh.com", "new", 3, 3)], "name string, status string, score int, bucket int")
    touched = kept.change(changes, lambda state, new: O.upsert_matches(state, new, ["name"], ["status"], []))
    assert touched == sorted({r[0] for r in changes.select(part_of(F.col("name"), 32)).collect()}) and len(touched) <= 2
    after = files()
    assert {f for f in before - after if not any(f"__part={p}/" in f for p in touched)} == set()
    assert {f for f in before & after} == {f for f in before if not any(f"__part={p}/" in f for p in touched)}
    got = {r.name: (r.status, r.score) for r in kept.read().collect()}
    assert len(got) == 2001 and got["5.com"] == ("new", 9) and got["fresh.com"] == ("new", 3) and got["6.com"] == ("new", 1)
    # Still bucketed: a second change joins without moving the state.
    assert plan_of(O.upsert_matches(kept.read(touched), changes, ["name"], ["status"], [])).count("Exchange hashpartitioning") == 1
    assert kept.change(changes.limit(0), lambda s, n: s) == []
