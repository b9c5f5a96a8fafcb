"""Views of the domain-monitoring tables over the test tables: as DataFrames, and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L

AS_OF = "2024-01-31"
TLDS = ("com", "net", "org", "com.br")
BRANDS = [
    (1, "thatin", "standard", ["login", "pay"]),
    (2, "attion", "conservative", []),
    (3, "ertion", "broad", ["heand"]),
    (4, "hehely", "standard", ["ing"]),
    (5, "thtion", "balanced", []),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token(spark: SparkSession, d: str) -> DataFrame:
    # Of text in lower case, as [^a-z0-9]+; it takes fewer steps for each character.
    words = F.explode(F.split(F.lower("text"), r"\P{Alnum}+")).alias("label")
    return table(spark, d, "documents").select("doc_id", words).filter(F.length("label").between(3, 63))


def _zone(tokens: DataFrame) -> DataFrame:
    rows = tokens.select("label").distinct()
    rows = rows.withColumn("tld", F.element_at(F.array(*map(F.lit, TLDS)), L.stable_shard(F.col("label"), 4) + 1)).withColumn("name", F.concat_ws(".", "label", "tld"))
    return rows.withColumn("added_day", L.stable_shard(F.col("name"), 31) + 20240101).select("name", "tld", "label", "added_day")


def zone_today(spark: SparkSession, d: str) -> DataFrame:
    """All labels of the documents."""
    return _zone(token(spark, d))


def zone_yesterday(spark: SparkSession, d: str) -> DataFrame:
    """A second snapshot, for differences: a tenth of the documents wasn't there yet, and names of another have gone since."""
    label = F.when(F.col("doc_id") % 10 == 1, F.concat("label", F.lit("-old"))).otherwise(F.col("label"))
    return _zone(token(spark, d).filter("doc_id % 10 <> 0").withColumn("label", label))


def brand(spark: SparkSession, d: str = "") -> DataFrame:
    return spark.createDataFrame(BRANDS, "brand_id int, brand_label string, noise_mode string, keywords array<string>")


def company(spark: SparkSession, d: str) -> DataFrame:
    """Brands by their owners' names: one for each supplier, with its nation as a keyword."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("nation"))
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    mode = _pick(("conservative", "standard", "broad", "balanced"), F.col("s_suppkey") % 4)
    words = F.array_compact(F.array(F.col("nation"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("pay"))))
    return rows.select(F.col("s_suppkey").alias("brand_id"), L.brand_text(F.col("s_name")).alias("brand_label"), mode.alias("noise_mode"), words.alias("keywords"))


def zone_xn(spark: SparkSession, d: str) -> DataFrame:
    """zone_today with encoded names in the place of those that begin with th."""
    z = zone_today(spark, d)
    label = F.when(F.startswith("label", F.lit("th")), F.concat(F.lit("xn--"), F.col("label"), F.lit("-"), F.substring(F.md5("label"), 1, 3))).otherwise(F.col("label"))
    z = z.withColumn("label", label)
    return z.withColumn("name", F.concat_ws(".", "label", "tld"))


def host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract(F.lower("url"), "^https?://([^/:?#]+)", 1).alias("host"))


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


RUN_TLDS = ("com", "net", "org", "com.br")


def run(spark: SparkSession, d: str) -> DataFrame:
    """Ingestion runs, one per event."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("success")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"),
        _pick(("czds", "openintel"), F.col("user_id") % 2).alias("source"),
        _pick(RUN_TLDS, F.floor(F.col("user_id") / 2) % 4).alias("tld"),
        status.alias("status"),
        _pick(("r2", "pg", "full"), F.col("event_id") % 3).alias("phase"),
        F.col("ts").alias("started_at"),
        F.when(status != "running", F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))).alias("finished_at"),
        F.when(status == "failed", _pick(("timeout", "no_snapshot", "load_error", "http_404"), F.col("event_id") % 4)).alias("reason_code"),
        k.alias("domains_seen"),
        F.floor(k / 2).cast("long").alias("domains_inserted"),
        F.floor(k / 3).cast("long").alias("domains_deleted"),
    )


def policy(spark: SparkSession, d: str) -> DataFrame:
    """One for each source and ending that was ever run, and one for an ending that never was."""
    seen = run(spark, d).select("source", "tld").distinct()
    rows = seen.unionByName(seen.select("source", F.lit("dev").alias("tld")).distinct())
    priority = F.when(F.col("tld") == "com", 10).when(F.col("tld") == "net", 20).when(F.col("tld") == "com.br", 150).when(F.col("tld") == "dev", 40)
    return rows.select("source", "tld", ((F.col("tld") != "org") | (F.col("source") == "czds")).alias("is_enabled"), priority.alias("priority"))


def event(spark: SparkSession, d: str) -> DataFrame:
    """Monitoring events with one signal each."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), F.col("event_type").alias("tool_name"), F.col("ts").alias("created_at"), k.alias("k"),
        _pick(("credential_collection_surface", "recent_registration", "parked_page", "mail_spoofing_risk"), k % 4).alias("code"),
        _pick(("critical", "high", "low", "medium"), k % 4).alias("severity"),
        ((k % 4) * 0.05).alias("score_adjustment"),
    )


def execution(spark: SparkSession, d: str) -> DataFrame:
    """Tool runs: who asked for what, when, and how long it took."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("organization_id"), F.col("user_id").alias("target"), F.col("event_type").alias("tool_type"),
        F.when(F.col("event_id") % 11 == 0, "failed").otherwise("completed").alias("status"), F.col("ts").alias("created_at"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"),
    )


_RUN_SQL = """(SELECT event_id AS id, CASE user_id % 2 WHEN 0 THEN 'czds' ELSE 'openintel' END AS source, (['com','net','org','com.br'])[CAST(floor(user_id / 2.0) AS BIGINT) % 4 + 1] AS tld,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS status, (['r2','pg','full'])[event_id % 3 + 1] AS phase, ts AS started_at,
  CASE WHEN event_type <> 'signup' THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS finished_at,
  CASE WHEN event_type = 'error' THEN (['timeout','no_snapshot','load_error','http_404'])[event_id % 4 + 1] END AS reason_code,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS domains_seen, CAST(floor(CAST(json_extract_string(props, '$.k') AS BIGINT) / 2.0) AS BIGINT) AS domains_inserted,
  CAST(floor(CAST(json_extract_string(props, '$.k') AS BIGINT) / 3.0) AS BIGINT) AS domains_deleted FROM events)"""
_POLICY_SQL = """(SELECT source, tld, (tld <> 'org' OR source = 'czds') AS is_enabled, CASE tld WHEN 'com' THEN 10 WHEN 'net' THEN 20 WHEN 'com.br' THEN 150 WHEN 'dev' THEN 40 END AS priority
  FROM (SELECT DISTINCT source, tld FROM run UNION SELECT DISTINCT source, 'dev' FROM run))"""
_COMPANY_SQL = """(SELECT s_suppkey AS brand_id, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS brand_label, (['conservative','standard','broad','balanced'])[s_suppkey % 4 + 1] AS noise_mode,
  list_filter([lower(n_name), CASE WHEN s_suppkey % 2 = 0 THEN 'pay' END], lambda x: x IS NOT NULL) AS keywords FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""
_XN_SQL = """(SELECT label || '.' || tld AS name, tld, label, added_day FROM (SELECT tld, added_day, CASE WHEN starts_with(label, 'th') THEN 'xn--' || label || '-' || substr(md5(label), 1, 3) ELSE label END AS label FROM zone_today))"""
_TOKEN_SQL = "(SELECT doc_id, label FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS label FROM documents) WHERE length(label) BETWEEN 3 AND 63)"
_SHARD = "(('0x' || substr(md5({0}), 1, 8))::BIGINT % {1})"


def _zone_sql(labels: str) -> str:
    named = f"(SELECT label, (['com','net','org','com.br'])[{_SHARD.format('label', 4)} + 1] AS tld FROM (SELECT DISTINCT {labels}))"
    return f"(SELECT label || '.' || tld AS name, tld, label, CAST({_SHARD.format("(label || '.' || tld)", 31)} + 20240101 AS INTEGER) AS added_day FROM {named})"


_EVENT_SQL = """(SELECT event_id AS id, user_id AS match_id, event_type AS tool_name, ts AS created_at, k, (['credential_collection_surface','recent_registration','parked_page','mail_spoofing_risk'])[k % 4 + 1] AS code,
  (['critical','high','low','medium'])[k % 4 + 1] AS severity, (k % 4) * CAST(0.05 AS DOUBLE) AS score_adjustment FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
_EXECUTION_SQL = """(SELECT event_id AS id, user_id % 7 AS organization_id, user_id AS target, event_type AS tool_type, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status,
  ts AS created_at, CAST(floor(value * 1000) AS BIGINT) AS duration_ms FROM events)"""
_BRAND_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{b}', '{m}', {k or '[]::VARCHAR[]'})" for i, b, m, k in BRANDS) + ") t(brand_id, brand_label, noise_mode, keywords))"
SQL = {
    "run": _RUN_SQL, "policy": _POLICY_SQL, "token": _TOKEN_SQL, "zone_today": _zone_sql("label FROM token"), "zone_yesterday": _zone_sql("CASE WHEN doc_id % 10 = 1 THEN label || '-old' ELSE label END AS label FROM token WHERE doc_id % 10 <> 0"), "event": _EVENT_SQL, "execution": _EXECUTION_SQL,
    "brand": _BRAND_SQL, "company": _COMPANY_SQL, "zone_xn": _XN_SQL, "host": "(SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host FROM pages)",
}


def sql(query: str, *views: str) -> str:
    """query, with the views that it names in front."""
    wanted = list(views)
    if "zone_xn" in wanted:
        wanted.insert(0, "zone_today")
    if {"zone_today", "zone_yesterday"} & set(wanted):
        wanted.insert(0, "token")
    if "policy" in wanted:
        wanted.insert(0, "run")
    return "WITH " + ", ".join(f"{v} AS {SQL[v]}" for v in dict.fromkeys(wanted)) + " " + query.strip()


def _pick_array(values: tuple[tuple[str, ...], ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.array(*map(F.lit, v)) for v in values]), (at + 1).cast("int"))
