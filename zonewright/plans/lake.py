"""Queries on snapshots, deltas and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import lake as O
from ..sources import zones as Z
from ..sources.state import Kept
from ..streaming import jobs as J
from . import views as V
from .register import SQL, query

_Z = ("zone_today", "zone_yesterday")


def _both(spark, d):
    return V.zone_today(spark, d), V.zone_yesterday(spark, d)


def _zone_text(spark, d):
    """The zone serialised as a registry would, with comments, wildcards and apex lines."""
    z = V.zone_today(spark, d)
    line = F.concat(F.upper("name"), F.lit(". 86400 in ns x."))
    return z.select("tld", F.explode(F.array(line, F.concat(F.lit("; "), "name"), F.concat(F.lit("*."), "name", F.lit(". 1 in a x")), F.concat("tld", F.lit(". 1 in soa x")))).alias("value"))


_NAMES = V.sql("SELECT name, tld FROM zone_today", "zone_today")


def _zone_files(spark, d):
    """The zone as gzipped files of each ending, read back as lines."""
    path = Z.scratch(spark, "zone-files")
    Z.write_zone_files(_zone_text(spark, d), path)
    return Z.read_zone_files(spark, path)


@query("SRC01_zone_scan", _NAMES)
def src01(spark, d):
    return Z.zone_names(_zone_files(spark, d), F.col("tld"))


@query("SRC02_zone_scan_sharded", V.sql(f"SELECT name, CAST({V._SHARD.format('name', 128)} AS INTEGER) AS shard FROM zone_today", "zone_today"))
def src02(spark, d):
    path = Z.scratch(spark, "zone-buckets")
    Z.stage_buckets(Z.zone_names(_zone_files(spark, d), F.col("tld")), path, 128, L.stable_shard)
    return spark.read.schema("name string, shard int").parquet(path)


@query("SRC03_qname_scan", V.sql("SELECT name FROM zone_today WHERE tld = 'com'", "zone_today"))
def src03(spark, d):
    log = V.zone_today(spark, d).select(F.explode(F.array(F.concat(F.lit("WWW.a."), "name", F.lit(".")), F.concat(F.lit("*."), "name"), F.lit("com."))).alias("qname"))
    return Z.query_names(log, "qname", "com")


@query("SRC04_qname_scan_batched", V.sql("SELECT name FROM zone_today WHERE tld = 'com.br'", "zone_today"))
def src04(spark, d):
    log = V.zone_today(spark, d).select(F.concat(F.lit("mail."), "name", F.lit("..")).alias("qname"))
    return Z.query_names(log, "qname", "com.br")


@query("SRC05_cctld_list_scan", V.sql("SELECT DISTINCT lower(label) AS name FROM token", "token"))
def src05(spark, d):
    return Z.list_names(V.token(spark, d).select(F.upper("label").alias("value")))


@query("SRC06_raw_preserving_scan", "SELECT lower(w) AS domain_norm, min(w) AS domain_raw, to_base64(encode(min(w))) AS domain_raw_b64 FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents) GROUP BY lower(w)")
def src06(spark, d):
    return Z.raw_names(V.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("value")))


@query("SRC07_snapshot_discovery", V.sql("SELECT source, tld, max(CAST(started_at AS DATE)) AS newest, min(CAST(started_at AS DATE)) AS earliest FROM run WHERE status = 'success' AND CAST(started_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' GROUP BY source, tld", "run"))
def src07(spark, d):
    day = F.to_date("started_at")
    r = V.run(spark, d).filter((F.col("status") == "success") & day.between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-25").cast("date")))
    return r.groupBy("source", "tld").agg(F.max(day).alias("newest"), F.min(day).alias("earliest"))


@query("SRC08_marker_lookback", V.sql(f"SELECT source, tld, max(CAST(started_at AS DATE)) AS marker FROM run WHERE status = 'success' AND CAST(started_at AS DATE) BETWEEN DATE '{V.AS_OF}' - 6 AND DATE '{V.AS_OF}' GROUP BY source, tld", "run"))
def src08(spark, d):
    today, day = F.lit(V.AS_OF).cast("date"), F.to_date("started_at")
    return V.run(spark, d).filter((F.col("status") == "success") & day.between(F.date_sub(today, 6), today)).groupBy("source", "tld").agg(F.max(day).alias("marker"))


@query("SRC12_success_marker", V.sql("SELECT source, tld, CAST(started_at AS DATE) AS day, max(domains_seen) AS seen FROM run WHERE status = 'success' GROUP BY ALL", "run"))
def src12(spark, d):
    return V.run(spark, d).filter("status = 'success'").groupBy("source", "tld", F.to_date("started_at").alias("day")).agg(F.max("domains_seen").alias("seen"))


@query("SRC13_delta_load", V.sql("SELECT t.name, t.tld, 20240131 AS added_day FROM zone_today t ANTI JOIN zone_yesterday y ON t.name = y.name", *_Z))
def src13(spark, d):
    t, y = _both(spark, d)
    return O.load_delta(t.select("name", "tld"), y, F.lit(20240131))


@query(
    "SRC13_delta_load_recovery",
    V.sql(
        f"""SELECT tld, coalesce(a.n, 0) AS added_loaded, CASE WHEN tld = 'org' THEN 0 ELSE coalesce(r.n, 0) END AS removed_loaded,
  CASE WHEN tld = 'org' THEN 'partial' WHEN odd THEN 'recovered' ELSE 'ok' END AS status,
  CASE WHEN tld = 'org' THEN 'removed_unrecoverable' WHEN odd THEN 'removed_sanitised_retry' END AS recovery_type,
  CASE WHEN tld <> 'org' THEN CASE WHEN odd THEN r.n ELSE nulls END END AS of_today
FROM (SELECT tld, count(*) AS n FROM zone_today ANTI JOIN zone_yesterday USING (name) GROUP BY tld) a
FULL JOIN (SELECT tld, count(*) AS n, count(*) FILTER (shard = 0) AS nulls, bool_or(tld = 'net' AND shard = 1) AS odd
  FROM (SELECT tld, {V._SHARD.format("name", 8)} AS shard FROM zone_yesterday ANTI JOIN zone_today USING (name)) GROUP BY tld) r USING (tld)""",
        *_Z,
    ),
)
def src13_recovery(spark, d):
    """A day's files of which one ending has days that are no numbers, and another a file that is no Parquet; loaded twice."""
    today, before = _both(spark, d)
    files = Z.scratch(spark, "delta-files")
    O.added(today, before).select("name", "label", "tld").write.partitionBy("tld").parquet(f"{files}/added")
    shard = L.stable_shard(F.col("name"), 8)
    text = F.when(shard == 0, None).when((F.col("tld") == "net") & (shard == 1), "unknown").otherwise("20240130")
    O.removed(today, before).select("name", text.alias("removed_day"), "tld").write.partitionBy("tld").parquet(f"{files}/removed")
    spark.createDataFrame([("no parquet", "org")], "value string, tld string").write.mode("append").partitionBy("tld").text(f"{files}/removed")
    target = Z.scratch(spark, "loaded")
    for _ in range(2):
        report = O.load_delta_files(spark, f"{files}/added", f"{files}/removed", target, 20240131)
    gone = spark.read.schema("name string, removed_day int, loaded_day int, tld string").parquet(f"{target}/domain_removed")
    return report.join(gone.groupBy("tld").agg(F.count_if(F.col("removed_day") == F.col("loaded_day")).alias("of_today")), "tld", "left")


_RESUME_AT = "2024-01-28 12:00:00"


@query(
    "SRC15_shard_resume",
    V.sql(
        f"""SELECT tld, CAST(shard AS INTEGER) AS shard, count(*) AS n FROM (SELECT tld, {V._SHARD.format("name", 8)} AS shard FROM zone_today) z
WHERE (tld, shard) NOT IN (SELECT (tld, id % 8) FROM run WHERE source = 'czds' AND status = 'success' AND phase = 'pg' AND started_at > TIMESTAMP '{_RESUME_AT}' - INTERVAL 24 HOUR AND started_at <= TIMESTAMP '{_RESUME_AT}') GROUP BY ALL""",
        "zone_today",
        "run",
    ),
)
def src15(spark, d):
    """Today's delta lies in eight files for each ending; those that runs have loaded in the last 24 hours are left out, the others are read."""
    path = Z.scratch(spark, "delta-files")
    z = V.zone_today(spark, d).withColumn("shard", L.stable_shard(F.col("name"), 8))
    z.repartition("tld", "shard").write.partitionBy("tld", "shard").parquet(f"{path}/source=czds/snapshot_date={V.AS_OF}")
    files = Z.list_files(spark, path).select("path", *[F.regexp_extract("path", f"{k}=([^/]+)/", 1).alias(k) for k in ("source", "tld", "snapshot_date")], F.lit("domain").alias("partition"), F.regexp_extract("path", "shard=([^/]+)/", 1).alias("shard_key"))
    run = V.run(spark, d).filter(f"phase = 'pg' AND started_at <= timestamp '{_RESUME_AT}'")
    status = F.when(F.col("status") == "success", "completed").otherwise(F.col("status"))
    checkpoints = run.select("source", "tld", F.lit(V.AS_OF).alias("snapshot_date"), F.lit("domain").alias("partition"), (F.col("id") % 8).cast("string").alias("shard_key"), status.alias("status"), F.col("started_at").alias("loaded_at"))
    left = Z.pending_files(files, checkpoints, F.lit(_RESUME_AT).cast("timestamp"))
    # The files of one day's delta.
    paths = [r.path for r in left.select("path").collect()]
    schema = "name string, label string, added_day int, tld string, shard int"
    rows = spark.read.schema(schema).option("basePath", f"{path}/source=czds/snapshot_date={V.AS_OF}").parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.groupBy("tld", "shard").agg(F.count(F.lit(1)).alias("n"))


@query("SRC16_contract_check", V.sql("SELECT DISTINCT source, tld, date_trunc('hour', started_at) AS hour FROM run r WHERE status = 'success' AND NOT EXISTS (SELECT 1 FROM run p WHERE p.source = r.source AND p.tld = r.tld AND date_trunc('hour', p.started_at) = date_trunc('hour', r.started_at) AND p.phase = 'full' AND p.domains_inserted > 0)", "run"))
def src16(spark, d):
    r = V.run(spark, d).withColumn("hour", F.date_trunc("hour", "started_at").cast("timestamp_ntz"))
    return O.pending(r.filter("status = 'success'").select("source", "tld", "hour").distinct(), r.filter("phase = 'full' AND domains_inserted > 0"), "source", "tld", "hour")


@query("SRC17_retention", V.sql(f"SELECT DISTINCT path, day AS snapshot_date FROM (SELECT 'delta/' || source || '/' || tld || '/snapshot_date=' || strftime(started_at, '%Y-%m-%d') || '/x' AS path, CAST(started_at AS DATE) AS day FROM run) WHERE day < DATE '{V.AS_OF}' - 14", "run"))
def src17(spark, d):
    paths = V.run(spark, d).select(F.concat(F.lit("delta/"), "source", F.lit("/"), "tld", F.lit("/snapshot_date="), F.date_format("started_at", "yyyy-MM-dd"), F.lit("/x")).alias("path")).distinct()
    return Z.expired_partitions(paths, F.lit(V.AS_OF).cast("date"), 14)


@query("SRC19_tld_list_from_partitions", V.sql("SELECT DISTINCT tld FROM zone_today", "zone_today"))
def src19(spark, d):
    return V.zone_today(spark, d).select("tld").distinct()


@query("SRC20_completeness_check", V.sql("SELECT source, tld FROM policy p WHERE is_enabled AND NOT EXISTS (SELECT 1 FROM run r WHERE r.source = p.source AND r.tld = p.tld AND r.status = 'success')", "run", "policy"))
def src20(spark, d):
    return O.pending(V.policy(spark, d).filter("is_enabled").select("source", "tld"), V.run(spark, d).filter("status = 'success'"), "source", "tld")


@query("JON01_anti_added", V.sql("SELECT name FROM zone_today ANTI JOIN zone_yesterday USING (name)", *_Z))
def jon01(spark, d):
    return O.added(*_both(spark, d)).select("name")


@query("JON02_anti_removed", V.sql("SELECT name FROM zone_yesterday ANTI JOIN zone_today USING (name)", *_Z))
def jon02(spark, d):
    return O.removed(*_both(spark, d)).select("name")


@query("JON03_left_prev_state", V.sql("SELECT t.name, y.added_day AS first_seen FROM zone_today t LEFT JOIN zone_yesterday y ON t.name = y.name", *_Z))
def jon03(spark, d):
    t, y = _both(spark, d)
    return t.select("name").join(y.select("name", F.col("added_day").alias("first_seen")), "name", "left")


_DIFF = "SELECT coalesce(t.name, y.name) AS name, coalesce(t.tld, y.tld) AS tld, CASE WHEN y.name IS NULL THEN 'added' ELSE 'removed' END AS op FROM zone_today t FULL JOIN zone_yesterday y ON t.name = y.name WHERE t.name IS NULL OR y.name IS NULL"


@query("SET01_snapshot_diff", V.sql(_DIFF, *_Z))
def set01(spark, d):
    return O.snapshot_diff(*_both(spark, d))


@query("AGG24_diff_counts", V.sql(f"SELECT tld, op, count(*) AS n FROM ({_DIFF}) GROUP BY tld, op", *_Z))
def agg24(spark, d):
    return O.snapshot_diff(*_both(spark, d)).groupBy("tld", "op").agg(F.count(F.lit(1)).alias("n"))


@query("JOB07_snapshot_diff_job", V.sql(f"SELECT tld, count(*) FILTER (WHERE op = 'added') AS added, count(*) FILTER (WHERE op = 'removed') AS removed FROM ({_DIFF}) GROUP BY tld", *_Z))
def job07(spark, d):
    today = Z.zone_names(_zone_text(spark, d), F.col("tld"))
    op = F.col("op")
    return O.snapshot_diff(today, V.zone_yesterday(spark, d)).groupBy("tld").agg(F.count_if(op == "added").alias("added"), F.count_if(op == "removed").alias("removed"))


_STATE = "SELECT name, tld, CAST(strptime(CAST(added_day AS VARCHAR), '%Y%m%d') AS DATE) AS first_seen, DATE '2024-01-30' AS last_seen FROM zone_yesterday"


@query("JOB08_lifecycle_state", V.sql(f"SELECT coalesce(t.name, s.name) AS name, coalesce(t.tld, s.tld) AS tld, coalesce(s.first_seen, DATE '{V.AS_OF}') AS first_seen, CASE WHEN t.name IS NOT NULL THEN DATE '{V.AS_OF}' ELSE s.last_seen END AS last_seen, t.name IS NOT NULL AS is_active FROM zone_today t FULL JOIN ({_STATE}) s ON t.name = s.name", *_Z))
def job08(spark, d):
    t, y = _both(spark, d)
    state = y.select("name", "tld", L.int_date(F.col("added_day")).alias("first_seen"), F.lit("2024-01-30").cast("date").alias("last_seen"))
    return O.lifecycle(t, state, F.lit(V.AS_OF).cast("date"))


@query("JOB08_lifecycle_state_kept", SQL["JOB08_lifecycle_state"])
def job08_kept(spark, d):
    """The same with the state in a kept table, which today's names are brought to and which then holds the next state."""
    t, y = _both(spark, d)
    state = y.select("name", "tld", L.int_date(F.col("added_day")).alias("first_seen"), F.lit("2024-01-30").cast("date").alias("last_seen"), F.lit(True).alias("is_active"))
    kept = Kept.create(state, "lifecycle")
    kept.change(t, lambda before, today: O.lifecycle(today, before.drop("is_active"), F.lit(V.AS_OF).cast("date")))
    return kept.read()


@query("SET04_state_concat", V.sql("SELECT name, max(a) AS is_active FROM (SELECT name, true AS a FROM zone_today UNION ALL SELECT name, false FROM zone_yesterday) GROUP BY name", *_Z))
def set04(spark, d):
    t, y = _both(spark, d)
    rows = t.select("name", F.lit(True).alias("is_active")).unionByName(y.select("name", F.lit(False).alias("is_active")))
    return O.newest(rows, ["name"], F.desc("is_active"))


@query("WIN11_dedup_keep_first", V.sql("SELECT label, min(doc_id) AS doc_id FROM token GROUP BY label", "token"))
def win11(spark, d):
    return O.newest(V.token(spark, d), ["label"], F.asc("doc_id")).select("label", "doc_id")


@query("SET05_tld_union", V.sql("SELECT tld FROM zone_today UNION SELECT tld FROM run", "zone_today", "run"))
def set05(spark, d):
    return V.zone_today(spark, d).select("tld").union(V.run(spark, d).select("tld")).distinct()


@query("AGG01_tld_counts", V.sql("SELECT tld, count(*) AS n FROM zone_today GROUP BY tld", "zone_today"))
def agg01(spark, d):
    return V.zone_today(spark, d).groupBy("tld").agg(F.count(F.lit(1)).alias("n"))


# Which of the two snapshots a name is in, from one pass over both, with the day of either.
_PRESENCE = """both_zones AS (SELECT name, max(y) AS y, max(t) AS t FROM (SELECT name, added_day AS y, NULL::INTEGER AS t FROM zone_yesterday
  UNION ALL SELECT name, NULL, added_day FROM zone_today) GROUP BY name)"""


def _presence(select: str) -> str:
    return V.sql("SELECT 1", *_Z).removesuffix(" SELECT 1") + f", {_PRESENCE} " + select


@query("STA06_expire_reactivate", _presence(f"SELECT name, CASE WHEN t IS DISTINCT FROM 20240131 THEN CASE WHEN {V._SHARD.format('name', 5)} = 0 THEN 20240110 WHEN t IS NULL THEN 20240131 END END AS expired_day FROM both_zones WHERE y IS NOT NULL"))
def sta06(spark, d):
    """A fifth of the matches expired earlier; names that are gone expire, and those that today's delta brings are active again."""
    t, y = _both(spark, d)
    matches = y.select("name", F.when(L.stable_shard(F.col("name"), 5) == 0, 20240110).alias("expired_day"))
    gone = O.removed(t, y).select("name", F.lit(20240131).alias("removed_day"))
    return O.expire(matches, gone, t.filter("added_day = 20240131"))


@query("JON16_update_from", _presence("SELECT name, CASE WHEN t IS NULL AND y < 20240120 THEN 20240131 END AS expired_day FROM both_zones WHERE y IS NOT NULL"))
def jon16(spark, d):
    """Names that are gone get the day; of those, the ones first seen late have been registered again by a later delta."""
    t, y = _both(spark, d)
    gone = O.removed(t, y)
    return O.expire(y.select("name"), gone.select("name", F.lit(20240131).alias("removed_day")), gone.filter("added_day >= 20240120"))


@query("JON14_exists_semi", V.sql("SELECT y.name FROM zone_yesterday y ANTI JOIN (SELECT * FROM zone_today WHERE added_day >= 20240125) t USING (name)", *_Z))
def jon14(spark, d):
    t, y = _both(spark, d)
    return O.removed(t.filter("added_day >= 20240125"), y).select("name")


@query("STA01_watermark_cursor", V.sql("SELECT tld, max(added_day) AS watermark, count(*) FILTER (WHERE added_day >= 20240120) AS reread FROM zone_today GROUP BY tld", "zone_today"))
def sta01(spark, d):
    return V.zone_today(spark, d).groupBy("tld").agg(F.max("added_day").alias("watermark"), F.count_if(F.col("added_day") >= 20240120).alias("reread"))


def _old_new(spark, d):
    """Matches of yesterday and today: a status by shard, a score by day."""
    def rows(z, plus):
        status = V._pick(("new", "dismissed", "confirmed_threat", "new"), L.stable_shard(F.col("name"), 4))
        return z.select("name", status.alias("status"), (F.col("added_day") + plus).alias("score"), (F.col("added_day") % 7 + plus).alias("bucket"), F.lit(plus).alias("first_detected"))
    t, y = _both(spark, d)
    return rows(y, 0), rows(t, 1)


def _match_sql(zone: str, plus: int) -> str:
    return f"SELECT name, (['new','dismissed','confirmed_threat','new'])[{V._SHARD.format('name', 4)} + 1] AS status, added_day + {plus} AS score, added_day % 7 + {plus} AS bucket, {plus} AS first_detected FROM {zone}"


@query("STA02_match_upsert", V.sql(f"SELECT coalesce(o.name, n.name) AS name, coalesce(o.status, n.status) AS status, coalesce(n.score, o.score) AS score, CASE WHEN o.status IN ('dismissed', 'confirmed_threat') THEN o.bucket ELSE coalesce(n.bucket, o.bucket) END AS bucket, coalesce(o.first_detected, n.first_detected) AS first_detected FROM ({_match_sql('zone_yesterday', 0)}) o FULL JOIN ({_match_sql('zone_today', 1)}) n ON o.name = n.name", *_Z))
def sta02(spark, d):
    old, new = _old_new(spark, d)
    return O.upsert_matches(old, new, ["name"], ["status", "first_detected"], ["bucket"])


@query("STA02_match_upsert_kept", SQL["STA02_match_upsert"])
def sta02_kept(spark, d):
    """The same through a kept table, of which the partitions that the new matches touch are replaced."""
    old, new = _old_new(spark, d)
    kept = Kept.create(old, "matches")
    kept.change(new, lambda state, changes: O.upsert_matches(state, changes, ["name"], ["status", "first_detected"], ["bucket"]))
    return kept.read()


@query("STA03_reconcile_full", V.sql(f"SELECT o.name, o.score FROM ({_match_sql('zone_yesterday', 0)}) o SEMI JOIN zone_today t ON o.name = t.name", *_Z))
def sta03(spark, d):
    old, _ = _old_new(spark, d)
    return old.join(V.zone_today(spark, d).select("name"), "name", "left_semi").select("name", "score")


@query("STA04_reconcile_delta", V.sql(f"SELECT o.name, o.score FROM ({_match_sql('zone_yesterday', 0)}) o ANTI JOIN (SELECT * FROM ({_match_sql('zone_today', 1)}) WHERE bucket < 3) n ON o.name = n.name", *_Z))
def sta04(spark, d):
    """Matches without those that were looked at again and fell below the threshold."""
    old, new = _old_new(spark, d)
    return old.join(new.filter("bucket < 3").select("name"), "name", "left_anti").select("name", "score")


@query("STA05_drop_subdomains", V.sql("SELECT page_id, host FROM host WHERE NOT contains(regexp_replace(host, '\\.example\\.(com|net|org)$', ''), '.')", "host"))
def sta05(spark, d):
    return V.host(spark, d).filter(~F.regexp_replace("host", r"\.example\.(com|net|org)$", "").contains(".")).select("page_id", "host")


@query("SET07_merge_precedence", V.sql("SELECT name, min(p) AS origin FROM (SELECT name, 0 AS p FROM zone_today UNION ALL SELECT name, 1 FROM zone_yesterday) GROUP BY name", *_Z))
def set07(spark, d):
    t, y = _both(spark, d)
    rows = t.select("name", F.lit(0).alias("origin")).unionByName(y.select("name", F.lit(1).alias("origin")))
    return O.newest(rows, ["name"], F.asc("origin"))


@query("SRC09_lake_write", V.sql("SELECT tld, count(*) AS n FROM zone_today WHERE tld <> 'com' OR added_day >= 20240115 GROUP BY tld", "zone_today"))
def src09(spark, d):
    """The zone by ending, of which one ending is then replaced; the others stay."""
    path, z = Z.scratch(spark, "lake"), V.zone_today(spark, d)
    Z.write_lake(z, path, "tld")
    Z.write_lake(z.filter("tld = 'com' AND added_day >= 20240115"), path, "tld")
    return spark.read.schema("name string, label string, added_day int, tld string").parquet(path).groupBy("tld").agg(F.count(F.lit(1)).alias("n"))


@query("SRC10_lenient_read", V.sql("SELECT name, CAST(NULL AS VARCHAR) AS registrar FROM zone_today", "zone_today"))
def src10(spark, d):
    path, schema = Z.scratch(spark, "lenient"), "name string, registrar string"
    V.zone_today(spark, d).write.parquet(path)
    return Z.lenient_read(spark, path, schema).unionByName(Z.lenient_read(spark, path + "-missing", schema))


@query("SRC18_run_log_sink", V.sql("SELECT CAST(id AS VARCHAR) AS run_id, source, tld, strftime(started_at, '%Y-%m-%d') AS snapshot_date, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, strftime(finished_at, '%Y-%m-%dT%H:%M:%S') AS finished_at, status, domains_seen AS total_snapshot_count, domains_inserted AS added_count, domains_deleted AS removed_count, 'raw/' || source || '/' || tld || '/' || strftime(started_at, '%Y-%m-%d') AS raw_object_key, reason_code AS error_message FROM run", "run"))
def src18(spark, d):
    """Two appends, read back."""
    path, log = Z.scratch(spark, "run-log"), Z.run_log(V.run(spark, d))
    for part in (0, 1):
        Z.append_log(log.filter(F.col("run_id").cast("long") % 2 == part), path)
    return spark.read.schema(Z.RUN_LOG).parquet(path)


@query("STR01_delta_stream", V.sql("SELECT name, tld FROM zone_today UNION SELECT name, tld FROM zone_yesterday", *_Z))
def str01(spark, d):
    """Two deltas arrive one after the other; the stream that takes the second has lost the first one's checkpoint and reads
    both. Each name is added once."""
    source, target = (Z.scratch(spark, n) for n in ("deltas", "domains"))
    for zone in reversed(_both(spark, d)):
        zone.select("name", "tld", "label", "added_day").write.mode("append").parquet(source)
        J.load_deltas(spark, source, target, Z.scratch(spark, "stream")).awaitTermination()
    return J.read_names(spark, target).select("name", "tld")
