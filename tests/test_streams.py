import datetime
import random

from pyspark.sql import functions as F

from zonewright.operators import enrichment as E
from zonewright.streaming import jobs as J


def _delta(spark, *names):
    return spark.createDataFrame([(n, "com", n[0], 1) for n in names], J.DELTA).coalesce(1)


def _names(spark, target):
    return sorted(r.name for r in J.read_names(spark, target).collect())


def test_delta_stream_adds_each_name_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    put = lambda *names: _delta(spark, *names).write.mode("append").parquet(source)
    put("a.com", "b.com", "a.com")
    J.load_deltas(spark, source, target, checkpoint).awaitTermination()
    put("b.com", "c.com")
    J.load_deltas(spark, source, target, checkpoint).awaitTermination()
    J.load_deltas(spark, source, target, checkpoint).awaitTermination()
    assert _names(spark, target) == ["a.com", "b.com", "c.com"]


def test_two_checkpoints_on_one_target_lose_nothing(spark, tmp_path):
    first, second, target = (str(tmp_path / x) for x in ("in1", "in2", "out"))
    _delta(spark, "a.com", "b.com").write.parquet(first)
    J.load_deltas(spark, first, target, str(tmp_path / "cp1")).awaitTermination()
    # A second source, and the first one again without its checkpoint: names that are there are known.
    _delta(spark, "b.com", "c.com").write.parquet(second)
    J.load_deltas(spark, second, target, str(tmp_path / "cp2")).awaitTermination()
    J.load_deltas(spark, first, target, str(tmp_path / "cp3")).awaitTermination()
    assert _names(spark, target) == ["a.com", "b.com", "c.com"]
    _delta(spark, "c.com", "d.com").write.mode("append").parquet(first)
    J.load_deltas(spark, first, target, str(tmp_path / "cp3")).awaitTermination()
    assert _names(spark, target) == ["a.com", "b.com", "c.com", "d.com"]


def test_a_repeated_batch_keeps_its_rows(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for names in (("a.com", "b.com"), ("b.com", "c.com", "c.com")):
        _delta(spark, *names).write.mode("append").parquet(source)
        J.load_deltas(spark, source, target, checkpoint).awaitTermination()
    # The last batch was written but not committed: it runs again.
    last = max(int(p.name) for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "cp" / "commits").iterdir():
        if p.name.lstrip(".").split(".")[0] == str(last):
            p.unlink()
    J.load_deltas(spark, source, target, checkpoint).awaitTermination()
    assert _names(spark, target) == ["a.com", "b.com", "c.com"]


def test_a_batch_does_not_read_the_target(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for i in range(3):
        _delta(spark, *[f"{i}-{k}.com" for k in range(50)]).write.mode("append").parquet(source)
        q = J.load_deltas(spark, source, target, checkpoint)
        q.awaitTermination()
        read = [s.numInputRows for p in q.recentProgress for s in p.sources if "/out" in s.description]
        assert sum(read) == 0
    assert len(_names(spark, target)) == 150


def test_windowed_counts_match_the_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.range(500).select(F.concat(F.lit("t"), F.col("id") % 3).alias("tool_name"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("created_at"))
    rows.write.parquet(path)
    stream = J.windowed_counts(spark.readStream.schema(rows.schema).parquet(path), late="0 seconds")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = rows.groupBy("tool_name", F.date_trunc("hour", "created_at").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


EVENT = "id long, match_id long, created_at timestamp, code string, severity string, score_adjustment double"


def test_states_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(5000)), rng.choice("abc"), rng.choice(["low", "high"]), rng.random()) for i in range(300)]
    rows += [(900, 9, datetime.datetime(2024, 1, 1), None, None, None)]
    newest = 20
    want = set()
    for match in {r[1] for r in rows}:
        seen = {}
        for r in sorted((r for r in rows if r[1] == match), key=lambda r: (r[2], r[0]), reverse=True)[:newest]:
            seen.setdefault(r[3], (match, r[3], r[4], r[5]))
        want |= set(seen.values())
    for turn in range(2):
        source, target, checkpoint = (str(tmp_path / f"{x}{turn}") for x in ("in", "out", "cp"))
        sent = rows + rng.sample(rows, 100)
        rng.shuffle(sent)
        for part in (sent[:150], sent[150:], sent[:50]):
            spark.createDataFrame(part, EVENT).write.mode("append").parquet(source)
            stream = J.newest_signals(spark.readStream.schema(EVENT).parquet(source), newest)
            J.run_into(stream, target, checkpoint).awaitTermination()
        # The last batch that touched a match says all about it.
        out = spark.read.parquet(target)
        last = out.groupBy("match_id").agg(F.max("batch").alias("batch"))
        got = out.join(last, ["match_id", "batch"]).select("match_id", "code", "severity", "adjustment").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_late_events_are_left_out_of_windows(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "tool_name string, created_at timestamp"
    for part in ([("a", at(9)), ("a", at(12, 30))], [("a", at(9, 10)), ("a", at(11, 40)), ("a", at(12, 59)), ("b", at(13))], [("a", at(12, 1)), ("a", at(11, 59))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        J.run_into(J.windowed_counts(spark.readStream.schema(schema).parquet(source)), target, checkpoint).awaitTermination()
    got = {(r.tool_name, r.start.hour): r.n for r in J.latest_rows(spark, target, "tool_name string, start timestamp, n long", ["tool_name", "start"]).collect()}
    # After 12:30 the watermark stands at 11:30, and after 13:00 at 12:00: 9:10 and 11:59 are late, 11:40 and 12:01 aren't.
    assert got == {("a", 9): 1, ("a", 11): 1, ("a", 12): 3, ("b", 13): 1}


def test_login_page_is_critical_and_parked_page_is_not(spark):
    login = "<html><title>Bank</title><style>p{}</style><form action=x><input type='password'></form>Please sign in</html>"
    rows = [(1, login), (2, "<p>Buy this domain today</p>"), (3, None), (4, "<script>var password</script>plain")]
    got = {r.page_id: (r.level, r.title, r.passwords, r.parked) for r in E.page_risk(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: ("critical", "Bank", 1, False), 2: ("none", "", 0, True), 3: ("none", "", 0, False), 4: ("none", "", 0, False)}
