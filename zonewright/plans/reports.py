"""Queries on ingestion runs, policies and tool runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import lake as O
from ..operators import reports as R
from ..operators import reviews as W
from ..sources import zones as Z
from ..streaming import jobs as J
from . import views as V
from .register import SQL, query

_NOW = f"TIMESTAMP '{V.AS_OF} 00:00:00'"
_DAY = f"DATE '{V.AS_OF}'"


def now():
    return F.lit(V.AS_OF + " 00:00:00").cast("timestamp_ntz")




@query("FLT05_run_filters", V.sql("SELECT id, started_at FROM run WHERE source = 'czds' AND status = 'failed' AND started_at >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY started_at DESC, id DESC LIMIT 100 OFFSET 5", "run"))
def flt05(spark, d):
    r = V.run(spark, d).filter((F.col("source") == "czds") & (F.col("status") == "failed") & (F.col("started_at") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")))
    return r.orderBy(F.desc("started_at"), F.desc("id")).offset(5).limit(100).select("id", "started_at")


@query("FLT06_incidents", V.sql(f"SELECT id, status, reason_code FROM run WHERE coalesce(finished_at, started_at) >= {_NOW} - INTERVAL 72 HOUR AND (status = 'failed' OR reason_code IN ('timeout', 'load_error'))", "run"))
def flt06(spark, d):
    at = F.coalesce("finished_at", "started_at")
    return V.run(spark, d).filter((at >= now() - F.expr("INTERVAL 72 HOURS")) & ((F.col("status") == "failed") | F.col("reason_code").isin("timeout", "load_error"))).select("id", "status", "reason_code")


@query("FLT10_policy_order", V.sql("SELECT source, tld, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(priority, 999999), tld) AS INTEGER) AS place FROM policy WHERE is_enabled", "policy"))
def flt10(spark, d):
    w = Window.partitionBy("source").orderBy(F.coalesce("priority", F.lit(999999)), "tld")
    return V.policy(spark, d).filter("is_enabled").select("source", "tld", F.row_number().over(w).alias("place"))


@query("AGG05_today_runs", V.sql("SELECT CAST(started_at AS DATE) AS day, count(*) FILTER (WHERE status = 'success') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running, min(started_at) AS first_start, avg(date_diff('second', started_at, finished_at)) FILTER (WHERE status = 'success') AS mean_seconds, min(tld) FILTER (WHERE status = 'running') AS running_tld FROM run GROUP BY 1", "run"))
def agg05(spark, d):
    r = V.run(spark, d).withColumn("sec", F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at")))
    return r.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count_if(R.ok()).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "running").alias("running"),
        F.min("started_at").alias("first_start"), F.avg(F.when(R.ok(), F.col("sec"))).alias("mean_seconds"), F.min(F.when(F.col("status") == "running", F.col("tld"))).alias("running_tld"),
    )


@query("AGG06_source_summary", V.sql("SELECT source, count(*) AS runs, max(started_at) AS last_run, max(started_at) FILTER (WHERE status = 'success') AS last_success, CAST(sum(domains_seen) AS BIGINT) AS seen, CAST(sum(domains_inserted) AS BIGINT) AS inserted, arg_max(status, (started_at, id)) AS last_status FROM run GROUP BY source", "run"))
def agg06(spark, d):
    return V.run(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.max("started_at").alias("last_run"), F.max(F.when(R.ok(), F.col("started_at"))).alias("last_success"),
        F.sum("domains_seen").alias("seen"), F.sum("domains_inserted").alias("inserted"), F.max_by("status", R.order_of()).alias("last_status"),
    )


@query("AGG07_running_freshness", V.sql(f"SELECT source, count(*) FILTER (WHERE started_at >= {_NOW} - INTERVAL 48 HOUR) AS active, count(*) FILTER (WHERE started_at < {_NOW} - INTERVAL 48 HOUR) AS stale FROM run WHERE status = 'running' GROUP BY source", "run"))
def agg07(spark, d):
    cut = now() - F.expr("INTERVAL 48 HOURS")
    return V.run(spark, d).filter("status = 'running'").groupBy("source").agg(F.count_if(F.col("started_at") >= cut).alias("active"), F.count_if(F.col("started_at") < cut).alias("stale"))


_DAILY = """daily AS (SELECT source, tld, day, max(status) FILTER (WHERE phase = 'full') AS full_status, max(status) FILTER (WHERE phase = 'r2') AS r2_status, max(status) FILTER (WHERE phase = 'pg') AS pg_status,
  CAST(sum(domains_inserted) AS BIGINT) AS inserted, CAST(sum(domains_deleted) AS BIGINT) AS deleted, min(started_at) AS first_start, max(finished_at) AS last_end
  FROM (SELECT *, CAST(started_at AS DATE) AS day, row_number() OVER (PARTITION BY source, tld, CAST(started_at AS DATE), phase ORDER BY (status = 'success') DESC, started_at DESC, id DESC) AS r FROM run) WHERE r = 1 GROUP BY source, tld, day)"""


def _with_daily(select: str, *more: str) -> str:
    return V.sql("SELECT 1", "run", *more).removesuffix(" SELECT 1") + f", {_DAILY} " + select


@query("WIN03_daily_status", _with_daily("SELECT * FROM daily"))
def win03(spark, d):
    return R.daily_status(V.run(spark, d))


@query("AGG08_daily_summary", _with_daily("SELECT source, day, count(*) FILTER (WHERE pg_status = 'success') AS done, count(*) FILTER (WHERE pg_status = 'failed') AS failed, count(*) FILTER (WHERE pg_status IS NULL) AS missing, CAST(sum(inserted) AS BIGINT) AS inserted, count(*) FILTER (WHERE pg_status = 'success') / CAST(count(*) AS DOUBLE) AS ratio FROM daily GROUP BY source, day"))
def agg08(spark, d):
    done = F.count_if(F.col("pg_status") == "success")
    return R.daily_status(V.run(spark, d)).groupBy("source", "day").agg(done.alias("done"), F.count_if(F.col("pg_status") == "failed").alias("failed"), F.count_if(F.col("pg_status").isNull()).alias("missing"), F.sum("inserted").alias("inserted"), (done / F.count(F.lit(1))).alias("ratio"))


@query("AGG19_phase_matrix", _with_daily("SELECT source, r2_status, pg_status, count(*) AS n FROM daily GROUP BY ALL"))
def agg19(spark, d):
    return R.daily_status(V.run(spark, d)).groupBy("source", "r2_status", "pg_status").agg(F.count(F.lit(1)).alias("n"))


@query("JON10_cycle_policy_matrix", _with_daily("SELECT p.source, p.tld, c.day, d.r2_status, d.pg_status FROM policy p CROSS JOIN (SELECT DISTINCT day FROM daily) c LEFT JOIN daily d ON d.source = p.source AND d.tld = p.tld AND d.day = c.day WHERE p.is_enabled", "policy"))
def jon10(spark, d):
    return _matrix(spark, d).select("source", "tld", "day", "r2_status", "pg_status")


def _matrix(spark, d):
    daily = R.daily_status(V.run(spark, d))
    keys = daily.select("day").distinct().crossJoin(F.broadcast(V.policy(spark, d).filter("is_enabled").select(*R.KEYS)))
    return keys.join(daily, [*R.KEYS, "day"], "left")


@query("AGG09_policy_coverage", _with_daily("SELECT p.source, c.day, count(*) AS enabled, count(d.day) AS attempted, count(*) FILTER (WHERE d.pg_status = 'success') AS success, count(*) FILTER (WHERE d.day IS NULL) AS not_reached, count(*) FILTER (WHERE d.pg_status = 'success') / CAST(count(*) AS DOUBLE) AS ratio FROM policy p CROSS JOIN (SELECT DISTINCT day FROM daily) c LEFT JOIN daily d ON d.source = p.source AND d.tld = p.tld AND d.day = c.day WHERE p.is_enabled GROUP BY p.source, c.day", "policy"))
def agg09(spark, d):
    good = F.count_if(F.col("pg_status") == "success")
    return _matrix(spark, d).groupBy("source", "day").agg(F.count(F.lit(1)).alias("enabled"), F.count("first_start").alias("attempted"), good.alias("success"), F.count_if(F.col("first_start").isNull()).alias("not_reached"), (good / F.count(F.lit(1))).alias("ratio"))


_FACTS = """facts AS (SELECT source, tld, arg_max(status, (started_at, id)) AS last_status, max(started_at) AS last_run, max(started_at) FILTER (WHERE status = 'success') AS last_success, max(started_at) FILTER (WHERE status = 'failed') AS last_failure,
  arg_max(reason_code, (started_at, id)) FILTER (WHERE status = 'failed') AS last_reason FROM run GROUP BY source, tld)"""


def _with_facts(select: str, *more: str) -> str:
    return V.sql("SELECT 1", "run", "policy", *more).removesuffix(" SELECT 1") + f", {_FACTS} " + select


@query("JON09_lateral_latest", _with_facts("SELECT p.source, p.tld, f.last_status, f.last_run, f.last_success, f.last_failure, f.last_reason FROM policy p LEFT JOIN facts f ON p.source = f.source AND p.tld = f.tld"))
def jon09(spark, d):
    return _facts(spark, d).select(*R.KEYS, "last_status", "last_run", "last_success", "last_failure", "last_reason")


def _facts(spark, d):
    return V.policy(spark, d).join(R.run_facts(V.run(spark, d)), R.KEYS, "left")


@query("FN39_tld_status", _with_facts(f"SELECT p.source, p.tld, CASE WHEN NOT p.is_enabled THEN 'disabled' WHEN f.last_status IS NULL THEN 'never' WHEN f.last_success IS NULL THEN 'failing' WHEN date_diff('day', CAST(f.last_success AS DATE), {_DAY}) <= 2 THEN 'healthy' ELSE 'stale' END AS state FROM policy p LEFT JOIN facts f ON p.source = f.source AND p.tld = f.tld"))
def fn39(spark, d):
    days = F.datediff(F.lit(V.AS_OF).cast("date"), F.to_date("last_success"))
    state = F.when(~F.col("is_enabled"), "disabled").when(F.col("last_status").isNull(), "never").when(F.col("last_success").isNull(), "failing").when(days <= 2, "healthy").otherwise("stale")
    return _facts(spark, d).select(*R.KEYS, state.alias("state"))


@query("WIN02_tld_health", V.sql("SELECT source, tld, id, status, reason_code FROM (SELECT *, row_number() OVER (PARTITION BY source, tld ORDER BY started_at DESC, id DESC) AS r FROM run) WHERE r = 1", "run"))
def win02(spark, d):
    return O.newest(V.run(spark, d), R.KEYS, F.desc("started_at"), F.desc("id")).select("source", "tld", "id", "status", "reason_code")


@query("WIN01_last_n_runs", V.sql("SELECT source, tld, string_agg(status, ',' ORDER BY started_at DESC, id DESC) AS statuses, max(r) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, tld ORDER BY started_at DESC, id DESC) AS r FROM run) WHERE r <= 5 GROUP BY source, tld", "run"))
def win01(spark, d):
    w = Window.partitionBy(*R.KEYS).orderBy(F.desc("started_at"), F.desc("id"))
    top = V.run(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return top.groupBy(*R.KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "status"))), lambda x: x["status"]), ",").alias("statuses"), F.max("r").cast("long").alias("n"))


@query("AGG15_volume_zscore", V.sql("SELECT * FROM (SELECT d.source, d.tld, d.day, d.n, (d.n - s.mean) / s.sd AS z FROM (SELECT source, tld, CAST(started_at AS DATE) AS day, CAST(sum(domains_inserted) AS BIGINT) AS n FROM run GROUP BY ALL) d JOIN (SELECT source, tld, avg(n) AS mean, stddev_samp(n) AS sd FROM (SELECT source, tld, CAST(started_at AS DATE) AS day, sum(domains_inserted) AS n FROM run GROUP BY ALL) GROUP BY source, tld HAVING count(*) >= 3 AND stddev_samp(n) > 0) s ON d.source = s.source AND d.tld = s.tld) WHERE abs(z) > 1.5", "run"))
def agg15(spark, d):
    daily = V.run(spark, d).groupBy(*R.KEYS, F.to_date("started_at").alias("day")).agg(F.sum("domains_inserted").alias("n"))
    return R.z_scores(daily, R.KEYS, "n").filter(F.abs("z") > 1.5).select(*R.KEYS, "day", "n", "z")


@query("AGG16_coverage_30d", V.sql("SELECT p.source, p.tld, count(r.day) AS ok_days FROM policy p LEFT JOIN (SELECT DISTINCT source, tld, CAST(started_at AS DATE) AS day FROM run WHERE status = 'success' AND phase = 'pg') r ON p.source = r.source AND p.tld = r.tld WHERE p.is_enabled GROUP BY p.source, p.tld HAVING count(r.day) < 0.99 * 30", "run", "policy"))
def agg16(spark, d):
    days = V.run(spark, d).filter(R.ok() & (F.col("phase") == "pg")).select(*R.KEYS, F.to_date("started_at").alias("day")).distinct()
    return V.policy(spark, d).filter("is_enabled").join(days, R.KEYS, "left").groupBy(*R.KEYS).agg(F.count("day").alias("ok_days")).filter(F.col("ok_days") < 0.99 * 30)


@query("AGG17_days_since_ok", _with_facts(f"SELECT p.source, p.tld, CAST(date_diff('day', CAST(f.last_success AS DATE), {_DAY}) AS INTEGER) AS days, CASE WHEN f.last_success IS NULL OR date_diff('day', CAST(f.last_success AS DATE), {_DAY}) > CASE p.source WHEN 'czds' THEN 2 ELSE 7 END THEN true ELSE false END AS late FROM policy p LEFT JOIN facts f ON p.source = f.source AND p.tld = f.tld WHERE p.is_enabled"))
def agg17(spark, d):
    days = F.datediff(F.lit(V.AS_OF).cast("date"), F.to_date("last_success"))
    late = F.coalesce(days > F.when(F.col("source") == "czds", 2).otherwise(7), F.lit(True))
    return _facts(spark, d).filter("is_enabled").select(*R.KEYS, days.alias("days"), late.alias("late"))


@query("AGG18_executive_summary", _with_facts("SELECT p.source, count(*) AS enabled, count(*) FILTER (WHERE f.last_status = 'success') AS complete, count(*) FILTER (WHERE f.last_status = 'failed') AS failed, count(*) FILTER (WHERE f.last_status = 'running') AS running, count(*) FILTER (WHERE f.last_status IS NULL) AS idle, 100.0 * count(*) FILTER (WHERE f.last_status = 'success') / CAST(count(*) AS DOUBLE) AS pct FROM policy p LEFT JOIN facts f ON p.source = f.source AND p.tld = f.tld WHERE p.is_enabled GROUP BY p.source"))
def agg18(spark, d):
    s, n = F.col("last_status"), F.count(F.lit(1))
    return _facts(spark, d).filter("is_enabled").groupBy("source").agg(n.alias("enabled"), F.count_if(s == "success").alias("complete"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "running").alias("running"), F.count_if(s.isNull()).alias("idle"), (F.count_if(s == "success") * 100.0 / n).alias("pct"))


@query("AGG23_tld_priority_bands", V.sql("SELECT source, count(*) AS enabled, count(*) FILTER (WHERE priority BETWEEN 1 AND 10) AS first, count(*) FILTER (WHERE priority BETWEEN 11 AND 100) AS second, count(*) FILTER (WHERE priority > 100 OR priority IS NULL) AS rest FROM policy WHERE is_enabled GROUP BY source", "policy"))
def agg23(spark, d):
    p = F.col("priority")
    return V.policy(spark, d).filter("is_enabled").groupBy("source").agg(F.count(F.lit(1)).alias("enabled"), F.count_if(p.between(1, 10)).alias("first"), F.count_if(p.between(11, 100)).alias("second"), F.count_if((p > 100) | p.isNull()).alias("rest"))


@query("AGG22_openintel_overall", _with_facts("SELECT source, CASE WHEN bool_or(last_status = 'failed') THEN 'failed' WHEN bool_or(coalesce(last_status, '') <> 'success') THEN 'warning' ELSE 'healthy' END AS overall FROM (SELECT p.source, f.last_status FROM policy p LEFT JOIN facts f ON p.source = f.source AND p.tld = f.tld WHERE p.is_enabled) GROUP BY source"))
def agg22(spark, d):
    s = F.coalesce("last_status", F.lit(""))
    return _facts(spark, d).filter("is_enabled").groupBy("source").agg(F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s != "success"), "warning").otherwise("healthy").alias("overall"))


@query("AGG26_cycle_progress", V.sql(f"SELECT source, CAST(started_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE status <> 'running') AS done, count(*) FILTER (WHERE status = 'running') AS remaining, avg(date_diff('second', started_at, finished_at)) * count(*) FILTER (WHERE status = 'running') AS eta_seconds FROM run GROUP BY 1, 2", "run"))
def agg26(spark, d):
    left = F.count_if(F.col("status") == "running")
    sec = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    return V.run(spark, d).groupBy("source", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "running").alias("done"), left.alias("remaining"), (F.avg(sec) * left).alias("eta_seconds"))


@query("JON15_not_exists", V.sql("SELECT source, tld FROM policy p WHERE is_enabled AND NOT EXISTS (SELECT 1 FROM run r WHERE r.source = p.source AND r.tld = p.tld AND r.status = 'success')", "run", "policy"))
def jon15(spark, d):
    return O.pending(V.policy(spark, d).filter("is_enabled"), V.run(spark, d).filter(R.ok()), *R.KEYS).select(*R.KEYS)


@query("JON17_policy_timeout_lookup", V.sql(f"SELECT r.id, CAST(coalesce(p.priority * 3600, 86400) AS INTEGER) AS timeout FROM run r LEFT JOIN policy p ON r.source = p.source AND r.tld = p.tld WHERE r.status = 'running'", "run", "policy"))
def jon17(spark, d):
    p = V.policy(spark, d).select(*R.KEYS, (F.col("priority") * 3600).alias("timeout"))
    return V.run(spark, d).filter("status = 'running'").join(F.broadcast(p), R.KEYS, "left").select("id", F.coalesce("timeout", F.lit(86400)).alias("timeout"))


@query("STA07_stale_runs", V.sql(f"SELECT r.id, 'failed' AS status, 'stale_recovered' AS reason_code FROM run r LEFT JOIN policy p ON r.source = p.source AND r.tld = p.tld WHERE r.status = 'running' AND date_diff('second', r.started_at, {_NOW}) > coalesce(p.priority * 3600, 86400)", "run", "policy"))
def sta07(spark, d):
    p = V.policy(spark, d).withColumn("timeout", F.col("priority") * 3600)
    return R.stale_runs(V.run(spark, d), p, now(), 86400).select("id", F.lit("failed").alias("status"), F.lit("stale_recovered").alias("reason_code"))


@query("JON21_policy_vs_runs", V.sql(f"SELECT p.source, count(*) AS enabled, count(r.tld) AS ok, 100.0 * count(r.tld) / CAST(count(*) AS DOUBLE) AS pct FROM policy p LEFT JOIN (SELECT DISTINCT source, tld FROM run WHERE status = 'success' AND CAST(started_at AS DATE) = DATE '2024-01-30') r ON p.source = r.source AND p.tld = r.tld WHERE p.is_enabled GROUP BY p.source", "run", "policy"))
def jon21(spark, d):
    done = V.run(spark, d).filter(R.ok() & (F.to_date("started_at") == F.lit("2024-01-30").cast("date"))).select(*R.KEYS).distinct().withColumn("ok", F.lit(1))
    return V.policy(spark, d).filter("is_enabled").join(done, R.KEYS, "left").groupBy("source").agg(F.count(F.lit(1)).alias("enabled"), F.count("ok").alias("ok"), (F.count("ok") * 100.0 / F.count(F.lit(1))).alias("pct"))


@query("JON22_stored_not_loaded", V.sql("SELECT a.source, a.tld, a.stored, b.status FROM (SELECT source, tld, max(started_at) AS stored FROM run WHERE phase = 'r2' AND status = 'success' GROUP BY ALL) a LEFT JOIN (SELECT source, tld, arg_max(status, (started_at, id)) AS status FROM run WHERE phase = 'pg' GROUP BY ALL) b ON a.source = b.source AND a.tld = b.tld WHERE b.status IS DISTINCT FROM 'success'", "run"))
def jon22(spark, d):
    r = V.run(spark, d)
    stored = r.filter((F.col("phase") == "r2") & R.ok()).groupBy(*R.KEYS).agg(F.max("started_at").alias("stored"))
    loaded = r.filter("phase = 'pg'").groupBy(*R.KEYS).agg(F.max_by("status", R.order_of()).alias("status"))
    return stored.join(loaded, R.KEYS, "left").filter(~F.col("status").eqNullSafe(F.lit("success")))


@query("JON23_data_without_partition", V.sql("SELECT DISTINCT source, tld FROM run r WHERE status = 'success' AND tld NOT IN (SELECT tld FROM zone_today WHERE tld <> 'net')", "run", "zone_today"))
def jon23(spark, d):
    have = V.zone_today(spark, d).filter(F.col("tld") != "net").select("tld").distinct()
    return V.run(spark, d).filter(R.ok()).select(*R.KEYS).distinct().join(have, "tld", "left_anti").select(*R.KEYS)


@query("JON24_count_drift", V.sql("SELECT a.source, a.tld, a.seen, c.n, 100.0 * (c.n - a.seen) / nullif(CAST(a.seen AS DOUBLE), 0) AS drift FROM (SELECT source, tld, arg_max(domains_seen, (started_at, id)) AS seen FROM run WHERE status = 'success' GROUP BY ALL) a LEFT JOIN (SELECT tld, count(*) AS n FROM zone_today GROUP BY tld) c ON a.tld = c.tld", "run", "zone_today"))
def jon24(spark, d):
    seen = V.run(spark, d).filter(R.ok()).groupBy(*R.KEYS).agg(F.max_by("domains_seen", R.order_of()).alias("seen"))
    have = V.zone_today(spark, d).groupBy("tld").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(have, "tld", "left").select(*R.KEYS, "seen", "n", ((F.col("n") - F.col("seen")) * 100.0 / F.nullif(F.col("seen").cast("double"), F.lit(0.0))).alias("drift"))


@query("JON25_loaded_but_empty", V.sql("SELECT a.source, a.tld, a.seen FROM (SELECT source, tld, arg_max(domains_seen, (started_at, id)) AS seen FROM run WHERE status = 'success' GROUP BY ALL) a LEFT JOIN (SELECT tld, count(*) AS n FROM zone_today WHERE tld <> 'org' GROUP BY tld) c ON a.tld = c.tld WHERE a.seen > 0 AND coalesce(c.n, 0) = 0", "run", "zone_today"))
def jon25(spark, d):
    seen = V.run(spark, d).filter(R.ok()).groupBy(*R.KEYS).agg(F.max_by("domains_seen", R.order_of()).alias("seen"))
    have = V.zone_today(spark, d).filter("tld <> 'org'").groupBy("tld").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(have, "tld", "left").filter("seen > 0 AND coalesce(n, 0) = 0").select(*R.KEYS, "seen")


@query("JON11_cycle_batch_lateral", V.sql("SELECT source, day, count(*) AS n, array_to_string(list_sort(list(DISTINCT tld))[1:3], ',') AS first_tlds FROM (SELECT *, CAST(started_at AS DATE) AS day FROM run) GROUP BY source, day", "run"))
def jon11(spark, d):
    return V.run(spark, d).groupBy("source", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("tld")), 1, 3), ",").alias("first_tlds"))


@query("SET08_heatmap_fill", V.sql("SELECT p.source, p.tld, c.day, CASE max(CASE r.status WHEN 'running' THEN 3 WHEN 'success' THEN 2 WHEN 'failed' THEN 1 END) WHEN 3 THEN 'running' WHEN 2 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'pending' END AS state FROM policy p CROSS JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-15', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day) c LEFT JOIN run r ON r.source = p.source AND r.tld = p.tld AND CAST(r.started_at AS DATE) = c.day GROUP BY p.source, p.tld, c.day", "run", "policy"))
def set08(spark, d):
    return R.heatmap(V.run(spark, d), V.policy(spark, d), "2024-01-15", "2024-02-02")


@query("FN38_heatmap_phase", _with_daily("SELECT source, tld, day, CASE r2_status WHEN 'success' THEN 'ok' WHEN 'failed' THEN 'failed' WHEN 'running' THEN 'running' ELSE 'pending' END AS stored, CASE pg_status WHEN 'success' THEN 'ok' WHEN 'failed' THEN 'failed' WHEN 'running' THEN 'running' ELSE 'pending' END AS loaded FROM daily"))
def fn38(spark, d):
    of = lambda c: F.when(F.col(c) == "success", "ok").when(F.col(c).isin("failed", "running"), F.col(c)).otherwise("pending")
    return R.daily_status(V.run(spark, d)).select(*R.KEYS, "day", of("r2_status").alias("stored"), of("pg_status").alias("loaded"))


@query("STA17_openintel_status", V.sql("SELECT tld, max(CAST(started_at AS DATE)) FILTER (WHERE status = 'success') AS last_ingested, max(CAST(started_at AS DATE)) AS last_verified FROM run WHERE source = 'openintel' GROUP BY tld", "run"))
def sta17(spark, d):
    day = F.to_date("started_at")
    return V.run(spark, d).filter("source = 'openintel'").groupBy("tld").agg(F.max(F.when(R.ok(), day)).alias("last_ingested"), F.max(day).alias("last_verified"))


@query("STA18_policy_upsert", V.sql("SELECT p.source, p.tld, coalesce(c.is_enabled, p.is_enabled) AS is_enabled FROM policy p LEFT JOIN (SELECT source, tld, bool_or(status = 'success') AS is_enabled FROM run WHERE tld <> 'net' GROUP BY ALL) c ON p.source = c.source AND p.tld = c.tld", "run", "policy"))
def sta18(spark, d):
    change = V.run(spark, d).filter("tld <> 'net'").groupBy(*R.KEYS).agg(F.bool_or(R.ok()).alias("now"))
    return V.policy(spark, d).join(change, R.KEYS, "left").select(*R.KEYS, F.coalesce("now", "is_enabled").alias("is_enabled"))


@query("SRT14_cycle_history", V.sql("SELECT source, day, n FROM (SELECT source, CAST(started_at AS DATE) AS day, count(*) AS n FROM run GROUP BY ALL) ORDER BY day DESC, source LIMIT 20", "run"))
def srt14(spark, d):
    return V.run(spark, d).groupBy("source", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day"), "source").limit(20)


@query("JON18_ttl_asof_lookup", V.sql("SELECT a.id, max(b.id) AS cached FROM execution a LEFT JOIN execution b ON a.organization_id = b.organization_id AND a.tool_type = b.tool_type AND a.target = b.target AND b.status = 'completed' AND b.id <> a.id AND b.created_at = (SELECT max(c.created_at) FROM execution c WHERE c.organization_id = a.organization_id AND c.tool_type = a.tool_type AND c.target = a.target AND c.status = 'completed' AND c.id <> a.id AND c.created_at <= a.created_at AND c.created_at > a.created_at - INTERVAL 5 DAY) GROUP BY a.id", "execution"))
def jon18(spark, d):
    """The newest completed result at or before each request, not older than the time to live."""
    e = V.execution(spark, d)
    keys = ["organization_id", "tool_type", "target"]
    return R.newest_before(e, keys, "created_at", "id", F.col("status") == "completed", "5 DAYS").select("id", "cached")


@query("STA16_rate_window", V.sql("SELECT id, count(*) OVER (PARTITION BY organization_id, tool_type ORDER BY epoch(date_trunc('second', created_at)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM execution", "execution"))
def sta16(spark, d):
    return R.trailing_count(V.execution(spark, d), ["organization_id", "tool_type"], "created_at", 3600).select("id", "recent")


@query("AGG21_tool_rollup", V.sql("SELECT target, CASE WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'partial' END AS status, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM execution GROUP BY target", "execution"))
def agg21(spark, d):
    return V.execution(spark, d).groupBy("target").agg(F.when(F.bool_and(F.col("status") == "completed"), "completed").otherwise("partial").alias("status"), F.sum("duration_ms").alias("duration_ms"))


@query("SRT10_tool_history", V.sql("SELECT id, created_at FROM execution WHERE organization_id = 3 AND tool_type = 'view' ORDER BY created_at DESC, id DESC LIMIT 50", "execution"))
def srt10(spark, d):
    return V.execution(spark, d).filter("organization_id = 3 AND tool_type = 'view'").orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "created_at")


@query("AGG20_job_status", V.sql("SELECT target, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS job FROM execution GROUP BY target", "execution"))
def agg20(spark, d):
    s = F.collect_set("status")
    return V.execution(spark, d).groupBy("target").agg(F.when(F.size(s) > 1, "partial").otherwise(F.get(s, F.lit(0))).alias("job"))


@query("STA14_event_idempotency", V.sql("SELECT target, tool_type, min(id) AS id FROM execution GROUP BY target, tool_type", "execution"))
def sta14(spark, d):
    return O.newest(V.execution(spark, d), ["target", "tool_type"], F.asc("id")).select("target", "tool_type", "id")


_EV = "signals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) AS n FROM event) WHERE n <= 200), last_signal AS (SELECT match_id, code, arg_max(severity, (created_at, id)) AS severity, arg_max(score_adjustment, (created_at, id)) AS adjustment FROM signals GROUP BY match_id, code)"


def _with_signals(select: str) -> str:
    return V.sql("SELECT 1", "event").removesuffix(" SELECT 1") + f", {_EV} " + select


def _last_signals(spark, d):
    return _last_signals_of(V.event(spark, d))


def _last_signals_of(events):
    """The latest signal of each code among a match's newest 200 events."""
    w = Window.partitionBy("match_id").orderBy(F.desc("created_at"), F.desc("id"))
    top, o = events.withColumn("n", F.row_number().over(w)).filter("n <= 200"), F.struct("created_at", "id")
    return top.groupBy("match_id", "code").agg(F.max_by("severity", o).alias("severity"), F.max_by("score_adjustment", o).alias("adjustment"))


@query("WIN08_latest_signal_per_code", _with_signals("SELECT * FROM last_signal"))
def win08(spark, d):
    return _last_signals(spark, d)


@query("WIN09_latest_tool_result", V.sql("SELECT match_id, tool_name, arg_max(k, (created_at, id)) AS k FROM event GROUP BY match_id, tool_name", "event"))
def win09(spark, d):
    return V.event(spark, d).groupBy("match_id", "tool_name").agg(F.max_by("k", F.struct("created_at", "id")).alias("k"))


@query("WIN10_latest_cycle", V.sql("SELECT match_id, arg_max(id, (created_at, id)) AS id, max(created_at) AS created_at FROM event GROUP BY match_id", "event"))
def win10(spark, d):
    return V.event(spark, d).groupBy("match_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


_SCORE = "floor(greatest(0.0, least(1.0, 0.4 + total)) * 10000.0 + 0.5) / 10000.0"
_SNAP = f"snap AS (SELECT match_id, {_SCORE} AS score, CASE WHEN list_contains(codes, 'credential_collection_surface') THEN 'critical' WHEN list_contains(codes, 'recent_registration') THEN 'high' WHEN len(codes) > 0 THEN 'medium' ELSE 'low' END AS risk, array_to_string(codes, ',') AS codes FROM (SELECT match_id, sum(adjustment) AS total, list_sort(list(code)) AS codes FROM last_signal GROUP BY match_id))"


def _snapshots(spark, d):
    return _snapshots_of(_last_signals(spark, d))


def _snapshots_of(signals):
    s = signals.groupBy("match_id").agg(F.array_sort(F.collect_list("code")).alias("codes"), F.sum("adjustment").alias("total"))
    has = lambda c: F.array_contains("codes", c)
    risk = F.when(has("credential_collection_surface"), "critical").when(has("recent_registration"), "high").when(F.size("codes") > 0, "medium").otherwise("low")
    score = L.round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("total") + 0.4)))
    return s.select("match_id", score.alias("score"), risk.alias("risk"), F.array_join("codes", ",").alias("codes"))


@query("JOB10_match_state", _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SNAP} SELECT match_id, score, risk, codes, CASE WHEN score >= 0.8 THEN 'immediate_attention' WHEN score >= 0.48 THEN 'defensive_gap' ELSE 'watchlist' END AS bucket FROM snap")
def job10(spark, d):
    return _with_bucket(_snapshots(spark, d))


def _with_bucket(snapshots):
    return snapshots.withColumn("bucket", F.when(F.col("score") >= 0.8, "immediate_attention").when(F.col("score") >= 0.48, "defensive_gap").otherwise("watchlist"))


@query("FN28_derived_score", _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SNAP} SELECT match_id, score FROM snap")
def fn28(spark, d):
    return _snapshots(spark, d).select("match_id", "score")


@query("FN30_derived_risk", _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SNAP} SELECT match_id, risk FROM snap")
def fn30(spark, d):
    return _snapshots(spark, d).select("match_id", "risk")


@query("FN29_derived_bucket", _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SNAP} SELECT match_id, CASE WHEN score >= 0.8 THEN 'immediate_attention' WHEN score >= 0.48 THEN 'defensive_gap' ELSE 'watchlist' END AS bucket FROM snap")
def fn29(spark, d):
    return job10(spark, d).select("match_id", "bucket")


@query("AGG10_bucket_counts", _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SNAP} SELECT CASE WHEN score >= 0.8 THEN 'immediate_attention' WHEN score >= 0.48 THEN 'defensive_gap' ELSE 'watchlist' END AS bucket, count(*) AS n FROM snap GROUP BY 1")
def agg10(spark, d):
    return job10(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SRT08_snapshot_pages", _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SNAP} SELECT match_id, score FROM snap ORDER BY score DESC, match_id LIMIT 50 OFFSET 10")
def srt08(spark, d):
    return _snapshots(spark, d).orderBy(F.desc("score"), "match_id").offset(10).limit(50).select("match_id", "score")


@query("AGG13_worst_health", V.sql("SELECT match_id, CASE max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'healthy' ELSE 'unknown' END AS health FROM event GROUP BY match_id", "event"))
def agg13(spark, d):
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    return V.event(spark, d).groupBy("match_id").agg(F.element_at(F.array(*map(F.lit, ("unknown", "healthy", "warning", "critical"))), F.max(rank) + 1).alias("health"))


@query("AGG02_discovery_trend", V.sql("SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(DISTINCT match_id) AS matches FROM event WHERE CAST(created_at AS DATE) >= DATE '2024-01-10' GROUP BY 1", "event"))
def agg02(spark, d):
    day = F.to_date("created_at")
    return V.event(spark, d).filter(day >= F.lit("2024-01-10").cast("date")).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.countDistinct("match_id").alias("matches"))


@query("AGG03_operational_totals", V.sql(f"SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE code = 'parked_page') AS parked, count(*) FILTER (WHERE created_at >= {_NOW} - INTERVAL 24 HOUR) AS day, count(*) FILTER (WHERE created_at >= {_NOW} - INTERVAL 7 DAY) AS week, max(created_at) AS latest FROM event", "event"))
def agg03(spark, d):
    at = F.col("created_at")
    return V.event(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("code") == "parked_page").alias("parked"), F.count_if(at >= now() - F.expr("INTERVAL 24 HOURS")).alias("day"), F.count_if(at >= now() - F.expr("INTERVAL 7 DAYS")).alias("week"), F.max(at).alias("latest"))


@query("AGG12_match_counts", V.sql("SELECT severity, code, count(*) AS n FROM event WHERE tool_name <> 'view' GROUP BY ALL", "event"))
def agg12(spark, d):
    return V.event(spark, d).filter("tool_name <> 'view'").groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query("AGG25_cycle_counters", V.sql("SELECT CAST(created_at AS DATE) AS day, tool_name, count(*) AS n, count(DISTINCT match_id) AS matches FROM event GROUP BY ALL", "event"))
def agg25(spark, d):
    return V.event(spark, d).groupBy(F.to_date("created_at").alias("day"), "tool_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("matches"))


@query("SRT06_top_rising", V.sql("SELECT id, k FROM event WHERE severity = 'critical' ORDER BY k DESC, created_at DESC, id DESC LIMIT 20", "event"))
def srt06(spark, d):
    return V.event(spark, d).filter("severity = 'critical'").orderBy(F.desc("k"), F.desc("created_at"), F.desc("id")).limit(20).select("id", "k")


@query("SRT07_new_since", V.sql("SELECT id FROM event WHERE severity = 'critical' AND created_at >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY created_at DESC, id DESC LIMIT 50", "event"))
def srt07(spark, d):
    return V.event(spark, d).filter((F.col("severity") == "critical") & (F.col("created_at") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id")


@query("SRT09_event_timeline", V.sql("SELECT match_id, id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS place FROM event", "event"))
def srt09(spark, d):
    return V.event(spark, d).select("match_id", "id", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("created_at"), F.desc("id"))).alias("place"))


@query("FN27_events_hash", V.sql("SELECT match_id, sha256('[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) || ']') AS hash FROM event GROUP BY match_id", "event"))
def fn27(spark, d):
    return V.event(spark, d).groupBy("match_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("id"))), 256).alias("hash"))


@query("FN26_state_fingerprint", _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SNAP} SELECT match_id, sha256(codes || '|' || risk || '|' || CAST(CAST(floor(score * 10000 + 0.5) AS BIGINT) AS VARCHAR)) AS fingerprint FROM snap")
def fn26(spark, d):
    return _snapshots(spark, d).select("match_id", F.sha2(F.concat_ws("|", "codes", "risk", F.floor(F.col("score") * 10000 + 0.5).cast("string")), 256).alias("fingerprint"))


_BUCKET_SQL = "CASE WHEN score >= 0.8 THEN 'immediate_attention' WHEN score >= 0.48 THEN 'defensive_gap' ELSE 'watchlist' END"
_PRINT_SQL = "sha256(codes || '|' || risk || '|' || CAST(CAST(floor(score * 10000 + 0.5) AS BIGINT) AS VARCHAR))"
_CUT = "2024-01-27"
_EARLIER = f"{_EV}, {_SNAP}".replace("last_signal", "last_earlier").replace("signals", "earlier").replace("snap AS", "snap_earlier AS").replace("FROM event", "FROM event_earlier")


def _fingerprints(spark, events):
    s = _with_bucket(_snapshots_of(_last_signals_of(events)))
    return s.select("match_id", "bucket", F.sha2(F.concat_ws("|", "codes", "risk", F.floor(F.col("score") * 10000 + 0.5).cast("string")), 256).alias("fingerprint"))


@query(
    "STA15_fingerprint_trigger",
    _with_signals("SELECT 1").removesuffix(" SELECT 1")
    + f""", {_SNAP}, event_earlier AS (SELECT * FROM event WHERE created_at < TIMESTAMP '{_CUT}'), {_EARLIER},
seen AS (SELECT match_id, {_PRINT_SQL} AS seen, derived_at FROM snap_earlier JOIN (SELECT match_id, max(created_at) AS derived_at FROM event_earlier GROUP BY match_id) USING (match_id) WHERE match_id % 3 <> 0),
now AS (SELECT match_id, {_BUCKET_SQL} AS bucket, {_PRINT_SQL} AS fingerprint FROM snap)
SELECT n.match_id, bucket, fingerprint, bucket <> 'watchlist' AND (seen IS NULL OR seen <> fingerprint OR derived_at < {_NOW} - INTERVAL 7 DAY) AS again FROM now n LEFT JOIN seen s ON n.match_id = s.match_id""",
)
def sta15(spark, d):
    """States from all events against assessments of two thirds of the matches some days before."""
    e = V.event(spark, d)
    earlier = e.filter(F.col("created_at") < F.lit(_CUT).cast("timestamp_ntz"))
    derived = earlier.groupBy("match_id").agg(F.max("created_at").alias("derived_at"))
    assessed = _fingerprints(spark, earlier).filter("match_id % 3 <> 0").join(derived, "match_id").withColumnRenamed("fingerprint", "seen")
    return W.needs_assessment(_fingerprints(spark, e), assessed, now()).select("match_id", "bucket", "fingerprint", "again")


_ACTIONS = """act AS (SELECT id AS action_id, match_id, created_at AS done, CASE WHEN k % 10 = 3 THEN 'owned' ELSE 'status' END AS action, (['new', 'dismissed', 'confirmed_threat', NULL, 'reviewing'])[k % 10 + 1] AS status,
  CASE WHEN id % 4 <> 0 THEN 'user' || (match_id % 7) END AS reviewer, CASE WHEN id % 6 = 0 THEN 'note ' || id END AS notes, id % 2 = 0 AS add_to_profile FROM event WHERE k % 10 < 5)"""


def _actions(spark, d):
    """Half of the events as what reviewers did."""
    k, e = F.col("k") % 10, V.event(spark, d).filter("k % 10 < 5")
    return e.select(
        F.col("id").alias("action_id"), "match_id", F.col("created_at").alias("at"), F.when(k == 3, "owned").otherwise("status").alias("action"), V._pick(("new", "dismissed", "confirmed_threat", None, "reviewing"), k).alias("status"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("user"), (F.col("match_id") % 7).cast("string"))).alias("reviewer"), F.when(F.col("id") % 6 == 0, F.concat(F.lit("note "), F.col("id").cast("string"))).alias("notes"), (F.col("id") % 2 == 0).alias("add_to_profile"),
    )


@query(
    "STA20_review_actions",
    V.sql("SELECT 1", "event").removesuffix(" SELECT 1")
    + f""", {_ACTIONS} SELECT match_id, arg_max(CASE WHEN action = 'owned' THEN 'dismissed' ELSE status END, (done, action_id)) AS status, bool_or(action = 'owned') AS self_owned,
  CASE WHEN bool_or(action = 'owned') THEN 'confirmed_owned' END AS ownership, CASE WHEN bool_or(action = 'owned') THEN 'self_owned' END AS auto_disposition, arg_max(reviewer, (done, action_id)) FILTER (WHERE action <> 'owned' AND reviewer IS NOT NULL) AS reviewed_by,
  max(done) FILTER (WHERE action = 'owned' OR reviewer IS NOT NULL) AS reviewed_at, arg_max(notes, (done, action_id)) FILTER (WHERE action <> 'owned' AND notes IS NOT NULL) AS notes FROM act GROUP BY match_id""",
)
def sta20(spark, d):
    return W.fold_actions(_actions(spark, d))


@query("STR02_event_state_stream", SQL["JOB10_match_state"])
def str02(spark, d):
    """Events arrive in two parts, the newer ones first and a third of them twice; the state of each match is that of the batch job."""
    source, target, checkpoint = (Z.scratch(spark, n) for n in ("events", "match-states", "stream"))
    e = V.event(spark, d).select("id", "match_id", F.col("created_at").cast("timestamp").alias("created_at"), "code", "severity", "score_adjustment")
    for part in (F.col("id") % 3 > 0, F.col("id") % 3 < 2):
        e.filter(part).write.mode("append").parquet(source)
        J.run_into(J.newest_signals(spark.readStream.schema(e.schema).parquet(source)), target, checkpoint, lambda signals: _with_bucket(_snapshots_of(signals))).awaitTermination()
    return J.latest_rows(spark, target, "match_id long, score double, risk string, codes string, bucket string", ["match_id"])


# Events of the first days that come only with the second part: they are late.
_LATE, _PART = "2024-01-19", "2024-01-20"
_ON_TIME = f"SELECT * FROM event WHERE NOT (id % 50 = 0 AND created_at < TIMESTAMP '{_LATE}')"


def _windows(spark, e, keys: tuple[str, ...], slide: str | None):
    """Hourly counts by a stream that gets e in two parts: the first one holds what came before _PART, without the late rows."""
    source, target, checkpoint = (Z.scratch(spark, n) for n in ("events", "counts", "stream"))
    e = e.withColumn("created_at", F.col("created_at").cast("timestamp"))
    day = lambda x: F.lit(x).cast("timestamp")
    first = (F.col("created_at") < day(_PART)) & ~((F.col("id") % 50 == 0) & (F.col("created_at") < day(_LATE)))
    for part in (first, ~first):
        e.filter(part).write.mode("append").parquet(source)
        J.run_into(J.windowed_counts(spark.readStream.schema(e.schema).parquet(source), slide=slide, keys=keys), target, checkpoint).awaitTermination()
    types = ", ".join(f"{k} {e.schema[k].dataType.simpleString()}" for k in keys)
    return J.latest_rows(spark, target, f"{types}, start timestamp, n long", [*keys, "start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("STR03_windowed_event_counts", V.sql(f"SELECT tool_name, time_bucket(INTERVAL 1 HOUR, created_at) AS start, count(*) AS n FROM ({_ON_TIME}) GROUP BY ALL", "event"))
def str03(spark, d):
    """Tumbling windows; events that come late are left out."""
    return _windows(spark, V.event(spark, d).select("id", "tool_name", "created_at"), ("tool_name",), None)


_SLIDING = f"""SELECT organization_id, tool_type, start, count(*) AS n FROM (SELECT organization_id, tool_type, time_bucket(INTERVAL 20 MINUTE, created_at) - INTERVAL 20 MINUTE * unnest(range(3)) AS start
  FROM ({_ON_TIME.replace('FROM event', 'FROM execution')})) GROUP BY ALL"""


@query("STA16_rate_window_stream", V.sql(_SLIDING, "execution"))
def sta16_stream(spark, d):
    """Tool runs of an organisation in sliding hours, every twenty minutes."""
    e = V.execution(spark, d).select("id", "organization_id", "tool_type", "created_at")
    return _windows(spark, e, ("organization_id", "tool_type"), "20 minutes")


@query("SRC21_alert_payload", V.sql("SELECT tool_name, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) FILTER (WHERE r <= 20) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY tool_name ORDER BY created_at DESC, id DESC) AS r FROM event) GROUP BY tool_name", "event"))
def src21(spark, d):
    e = V.event(spark, d)
    w = Window.partitionBy("tool_name").orderBy(F.desc("created_at"), F.desc("id"))
    top = e.withColumn("r", F.row_number().over(w)).filter("r <= 20").groupBy("tool_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("newest"))
    return e.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n")).join(top, "tool_name")
