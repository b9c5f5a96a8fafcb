import datetime
import random

from pyspark.sql import functions as F

from zonewright.operators import reviews as W
from zonewright.operators.ranks import budget_rank, distributed_rank

DAY = lambda n, h=0: datetime.datetime(2024, 1, n, h)


def test_actions_fold_by_time(spark):
    rows = [
        (1, 1, DAY(2), "status", "confirmed_threat", "ann", "bad", None),
        (2, 1, DAY(1), "status", "dismissed", "bob", None, None),
        (3, 2, DAY(1), "owned", None, None, None, True),
        (4, 2, DAY(3), "status", "new", None, None, None),
        (5, 3, DAY(1), "status", "dismissed", "ann", "old note", None),
        (6, 3, DAY(1), "owned", None, "cy", "unused", False),
        (7, 4, DAY(1), "status", None, "ann", None, None),
    ]
    actions = spark.createDataFrame([*rows, rows[0], rows[2]], W.ACTION)
    got = {r.match_id: (r.status, r.self_owned, r.ownership, r.auto_disposition, r.reviewed_by, r.reviewed_at, r.notes) for r in W.fold_actions(actions).collect()}
    assert got == {
        1: ("confirmed_threat", False, None, None, "ann", DAY(2), "bad"),
        2: ("new", True, "confirmed_owned", "self_owned", None, DAY(1), None),
        3: ("dismissed", True, "confirmed_owned", "self_owned", "ann", DAY(1), "old note"),
    }
    matches = spark.createDataFrame([(1, 7, "a.com"), (2, 7, "b.com"), (3, 7, "c.com")], "match_id long, brand_id int, name string")
    assert [tuple(r) for r in W.confirmed_names(actions, matches).collect()] == [(7, "b.com")]


def test_assessment_triggers(spark):
    states = spark.createDataFrame([(1, "immediate_attention", "x"), (2, "defensive_gap", "x"), (3, "defensive_gap", "x"), (4, "watchlist", "x"), (5, "defensive_gap", "x")], "match_id long, bucket string, fingerprint string")
    assessed = spark.createDataFrame([(1, "x", DAY(30)), (2, "y", DAY(30)), (3, "x", DAY(20)), (4, "y", DAY(1))], "match_id long, seen string, derived_at timestamp")
    got = {r.match_id: r.again for r in W.needs_assessment(states, assessed, F.lit(DAY(31))).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True}


def test_ranks_of_one_large_group_are_spread(spark):
    rng = random.Random(1)
    rows = [(1 if i % 10 else None, rng.randrange(50), i) for i in range(5000)]
    d = spark.createDataFrame(rows, "g int, v int, id int").repartition(7)
    got = distributed_rank(d, ["g"], [F.desc("v"), F.col("id").asc()])
    want = {}
    for g in (1, None):
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = k
    assert {r.id: r["rank"] for r in got.collect()} == want
    assert distributed_rank(d.limit(0), ["g"], [F.col("id").asc()]).collect() == []


def test_budget(spark):
    rows = [(1, f"i{i}", "immediate_attention", 0.9, i / 10, None, None, DAY(1), None) for i in range(4)]
    rows += [(1, "today", "watchlist", 0.1, None, None, "", DAY(31), None), (1, "gap", "defensive_gap", 0.1, 0.2, None, None, DAY(1), None), (1, "good", "watchlist", 0.6, 0.9, None, None, DAY(1), None)]
    rows += [(1, "stale", "watchlist", 0.1, 0.9, None, None, DAY(1), DAY(20)), (1, "fresh", "watchlist", 0.1, 0.9, None, None, DAY(1), DAY(30)), (1, "mine", "immediate_attention", 1.0, 1.0, None, "self_owned", DAY(1), None), (1, "gone", "defensive_gap", 1.0, 1.0, "dismissed", None, DAY(1), None)]
    rows += [(2, "only", "watchlist", 0.1, 0.1, None, None, DAY(1), None)]
    d = spark.createDataFrame(rows, "brand_id int, name string, attention_bucket string, score_final double, actionability_score double, disposition string, auto_disposition string, first_detected date, last_enriched date")
    rank = lambda n: {r.name: r.budget_rank for r in budget_rank(d, n, F.lit(DAY(31)).cast("date")).collect()}
    order = ["i3", "i2", "i1", "i0", "today", "gap", "good", "stale", "fresh"]
    assert rank(50) == {**{n: k for k, n in enumerate(order, 1)}, "mine": None, "gone": None, "only": 1}
    # Those that need attention at once have no limit.
    assert rank(2) == {**dict.fromkeys(order), **{n: k for k, n in enumerate(order[:4], 1)}, "mine": None, "gone": None, "only": 1}
