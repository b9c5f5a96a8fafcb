"""Queries on tool results and pages; results are derived from events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import enrichment as E
from . import views as V
from .register import query

_T = """t AS (SELECT id, match_id, k, k % 5 AS a, k % 7 AS b, k % 11 AS c FROM event)"""


def _sql(select: str) -> str:
    return V.sql("SELECT 1", "event").removesuffix(" SELECT 1") + f", {_T} " + select


def _t(spark, d):
    e = V.event(spark, d)
    return e.select("id", "match_id", "k", (F.col("k") % 5).alias("a"), (F.col("k") % 7).alias("b"), (F.col("k") % 11).alias("c"))


def _applied(spark, d, rules):
    points, codes = E.adjustments(rules)
    return _t(spark, d).select("id", L.round4(points).alias("points"), F.array_join(codes, ",").alias("codes"))


def _rules_sql(*rules: tuple[str, float, str]) -> str:
    points = " + ".join(f"CASE WHEN {c} THEN CAST({p} AS DOUBLE) ELSE 0 END" for c, p, _ in rules)
    codes = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in rules)
    return _sql(f"SELECT id, floor(({points}) * 10000.0 + 0.5) / 10000.0 AS points, concat_ws(',', {codes}) AS codes FROM t")




@query("ENR01_whois_age", _rules_sql(("k <= 30", 0.18, "recent_registration"), ("k > 30 AND k <= 90", 0.10, "fresh_registration")))
def enr01(spark, d):
    return _applied(spark, d, E.whois_rules(F.col("k")))


@query("ENR02_dns", _rules_sql(("a <> 0 AND b <> 0 AND c <> 0", -0.08, "no_active_dns"), ("a <> 0 AND b <> 0 AND c = 0", 0.12, "mail_only_infrastructure")))
def enr02(spark, d):
    return _applied(spark, d, E.dns_rules(F.col("a") == 0, F.col("b") == 0, F.col("c") == 0))


def _status():
    return V._pick((200, 301, 403, 404, 503), F.col("a"))


_STATUS_SQL = "([200, 301, 403, 404, 503])[a + 1]"


@query("ENR03_http", _rules_sql((f"{_STATUS_SQL} = 200", 0.05, "live_http_service"), (f"{_STATUS_SQL} IN (401, 403, 429, 503)", 0.06, "restricted_live_service"), ("b > 2", 0.03, "https_live")))
def enr03(spark, d):
    return _applied(spark, d, E.http_rules(_status(), F.when(F.col("b") > 2, "https://x/").otherwise("http://x/")))


_LEVELS = ("critical", "high", "medium", "low", "none")
_LEVEL_SQL = "(['critical','high','medium','low','none'])[a + 1]"


@query("ENR04_page", _rules_sql(("b = 0", -0.22, "parked_page"), ("b = 1", 0.05, "challenge_page"), ("c < 3", 0.26, "credential_collection_surface"), ("a = 0", 0.22, "critical_page_risk"), ("a = 1", 0.14, "high_page_risk"), ("a = 2", 0.06, "medium_page_risk"), ("a = 3", 0.04, "low_page_risk")))
def enr04(spark, d):
    return _applied(spark, d, E.page_rules(F.when(F.col("b") == 0, "parked").when(F.col("b") == 1, "challenge").otherwise("live"), F.col("c") < 3, V._pick(_LEVELS, F.col("a"))))


@query("ENR05_email", _rules_sql(("a = 0", 0.16, "mail_spoofing_critical"), ("a = 1", 0.09, "mail_spoofing_high")))
def enr05(spark, d):
    return _applied(spark, d, E.email_rules(V._pick(_LEVELS, F.col("a"))))


@query("ENR06_geo", _rules_sql(("a < 2", 0.12, "risky_hosting_country"), ("b = 3", 0.08, "bulletproof_hosting")))
def enr06(spark, d):
    return _applied(spark, d, E.geo_rules(V._pick(("RU", "IR", "DE", "BR", "US"), F.col("a")), F.when(F.col("b") == 3, "DDoS-Guard LTD").otherwise("Some Host")))


@query("ENR07_ssl", _rules_sql(("a = 4", 0.25, "certificate_revoked")))
def enr07(spark, d):
    return _applied(spark, d, E.ssl_rules(F.col("a") == 4))


@query("ENR08_safe_browsing", _rules_sql(("b = 2", 0.30, "safe_browsing_listed")))
def enr08(spark, d):
    return _applied(spark, d, E.safe_browsing_rules(F.col("b") == 2))


@query("ENR09_threat_feeds", _rules_sql(("a = 0", 0.20, "urlhaus_listed"), ("b = 0 AND c < 5", 0.28, "phishtank_verified"), ("b = 0 AND c >= 5", 0.12, "phishtank_unverified")))
def enr09(spark, d):
    return _applied(spark, d, E.feed_rules(F.col("a") == 0, F.col("b") == 0, F.col("c") < 5))


@query("ENR10_clone", _rules_sql(("a = 0 OR c / 10.0 >= 0.75", 0.20, "website_clone"), ("NOT (a = 0 OR c / 10.0 >= 0.75) AND c / 10.0 >= 0.5", 0.10, "website_similar")))
def enr10(spark, d):
    return _applied(spark, d, E.clone_rules(F.col("a") == 0, F.col("c") / 10.0))


@query("ENR14_confidence", _sql("SELECT id, floor(greatest(0.15, least(1.0, k / 100.0 * CAST(0.7 AS DOUBLE) + a * CAST(0.04 AS DOUBLE) - b * CAST(0.08 AS DOUBLE) + c * CAST(0.01 AS DOUBLE))) * 10000.0 + 0.5) / 10000.0 AS confidence FROM t"))
def enr14(spark, d):
    return _t(spark, d).select("id", L.round4(E.confidence(F.col("k") / 100.0, F.col("a"), F.col("b"), F.col("c"))).alias("confidence"))


@query("ENR15_reasons_merge", _sql("SELECT id, array_to_string(list_sort(list_distinct(list_filter(['r' || a, 'r' || b, 'r' || c], lambda x: true))), ',') AS reasons FROM t"))
def enr15(spark, d):
    r = lambda c: F.concat(F.lit("r"), c.cast("string"))
    return _t(spark, d).select("id", F.array_join(E.merged_reasons(F.array(r(F.col("a")), r(F.col("b"))), F.array(r(F.col("c")))), ",").alias("reasons"))


@query("ENR16_fqdn_fix", V.sql("SELECT name, CASE WHEN ends_with(n, '.' || tld) THEN n ELSE n || '.' || tld END AS fqdn FROM (SELECT name, tld, CASE WHEN added_day % 2 = 0 THEN name ELSE label END AS n FROM zone_today)", "zone_today"))
def enr16(spark, d):
    n = F.when(F.col("added_day") % 2 == 0, F.col("name")).otherwise(F.col("label"))
    return V.zone_today(spark, d).select("name", E.with_tld(n, F.col("tld")).alias("fqdn"))


_HTML = "coalesce(html, '')"
_TEXT = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_HTML}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"
_PAGE = f"""WITH x AS (SELECT page_id, regexp_extract({_HTML}, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all({_HTML}, '(?i)<form[\\s>]')) AS forms, len(regexp_extract_all({_HTML}, '(?i)<input[\\s>]')) AS inputs,
  len(regexp_extract_all({_HTML}, '(?i)<input[^>]*type=.?password')) AS passwords, len(regexp_extract_all({_HTML}, '(?i)<script[\\s>]')) AS scripts, {_TEXT} AS body FROM pages),
y AS (SELECT *, {' OR '.join(f"contains(body, '{w}')" for w in E.PARKED_WORDS)} AS parked, {' OR '.join(f"contains(body, '{w}')" for w in E.CREDENTIAL_WORDS)} AS asks FROM x),
z AS (SELECT *, greatest(0.0, CASE WHEN passwords > 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CASE WHEN asks THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN forms > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN parked THEN CAST(0.3 AS DOUBLE) ELSE 0 END) AS score FROM y)
SELECT page_id, title, CAST(forms AS INTEGER) AS forms, CAST(inputs AS INTEGER) AS inputs, CAST(passwords AS INTEGER) AS passwords, CAST(scripts AS INTEGER) AS scripts, CAST(length(body) AS INTEGER) AS chars, parked, asks, score,
  CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.2 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM z"""


@query("JOB12_page_risk", _PAGE)
def job12(spark, d):
    return E.page_risk(V.table(spark, d, "pages").select("page_id", "html"))


@query("HLT02_health_status", _sql("SELECT id, CASE WHEN a = 1 OR b = 1 THEN 'critical' WHEN c = 1 THEN 'warning' WHEN a = 0 AND b = 0 AND c = 0 THEN 'unknown' ELSE 'healthy' END AS health FROM t"))
def hlt02(spark, d):
    check = lambda x: F.when(x != 0, x != 1)
    return _t(spark, d).select("id", E.health_status([(check(F.col("a")), "critical"), (check(F.col("b")), "critical"), (check(F.col("c")), "warning")]).alias("health"))


@query("JOB09_enrichment_rescore", _sql("SELECT id, floor(greatest(0.0, least(1.0, CAST(0.4 AS DOUBLE) + CASE WHEN k <= 30 THEN CAST(0.18 AS DOUBLE) WHEN k <= 90 THEN CAST(0.10 AS DOUBLE) ELSE 0 END + CASE WHEN a = 0 THEN CAST(0.16 AS DOUBLE) WHEN a = 1 THEN CAST(0.09 AS DOUBLE) ELSE 0 END + CASE WHEN b = 2 THEN CAST(0.30 AS DOUBLE) ELSE 0 END + CASE WHEN a = 4 THEN CAST(0.25 AS DOUBLE) ELSE 0 END)) * 10000.0 + 0.5) / 10000.0 AS score FROM t"))
def job09(spark, d):
    points, _ = E.adjustments(E.whois_rules(F.col("k")) + E.email_rules(V._pick(_LEVELS, F.col("a"))) + E.safe_browsing_rules(F.col("b") == 2) + E.ssl_rules(F.col("a") == 4))
    return _t(spark, d).select("id", L.round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points + 0.4))).alias("score"))


_ALL_RULES = (
    ("k <= 30", 0.18, "recent_registration"), ("k > 30 AND k <= 90", 0.10, "fresh_registration"),
    ("a <> 0 AND b <> 0 AND c <> 0", -0.08, "no_active_dns"), ("a <> 0 AND b <> 0 AND c = 0", 0.12, "mail_only_infrastructure"),
    (f"{_STATUS_SQL} = 200", 0.05, "live_http_service"), (f"{_STATUS_SQL} IN (401, 403, 429, 503)", 0.06, "restricted_live_service"), ("b > 2", 0.03, "https_live"),
    ("b = 0", -0.22, "parked_page"), ("b = 1", 0.05, "challenge_page"), ("c < 3", 0.26, "credential_collection_surface"),
    ("a = 0", 0.22, "critical_page_risk"), ("a = 1", 0.14, "high_page_risk"), ("a = 2", 0.06, "medium_page_risk"), ("a = 3", 0.04, "low_page_risk"),
    ("a = 0", 0.16, "mail_spoofing_critical"), ("a = 1", 0.09, "mail_spoofing_high"), ("a < 2", 0.12, "risky_hosting_country"), ("b = 3", 0.08, "bulletproof_hosting"),
    ("a = 4", 0.25, "certificate_revoked"), ("b = 2", 0.30, "safe_browsing_listed"),
    ("a = 0", 0.20, "urlhaus_listed"), ("b = 0 AND c < 5", 0.28, "phishtank_verified"), ("b = 0 AND c >= 5", 0.12, "phishtank_unverified"),
    ("a = 0 OR c / 10.0 >= 0.75", 0.20, "website_clone"), ("NOT (a = 0 OR c / 10.0 >= 0.75) AND c / 10.0 >= 0.5", 0.10, "website_similar"),
)
_POINTS_SQL = " + ".join(f"CASE WHEN {c} THEN CAST({p} AS DOUBLE) ELSE 0 END" for c, p, _ in _ALL_RULES)
_CODES_SQL = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in _ALL_RULES)
_CLIP_SQL = "floor(greatest({0}, least(1.0, {1})) * 10000.0 + 0.5) / 10000.0"


@query(
    "JOB09_enrichment_all_rules",
    _sql(f"""SELECT id, score, array_to_string(codes, ',') AS codes, {_CLIP_SQL.format('0.15', 'score * CAST(0.7 AS DOUBLE) + a * CAST(0.04 AS DOUBLE) - b * CAST(0.08 AS DOUBLE) + len(codes) * CAST(0.01 AS DOUBLE)')} AS confidence,
  array_to_string(list_sort(list_distinct(list_concat(['lexical_similarity'], codes))), ',') AS reasons
FROM (SELECT id, a, b, {_CLIP_SQL.format('0.0', f'CAST(0.4 AS DOUBLE) + ({_POINTS_SQL})')} AS score, list_filter([{_CODES_SQL}], lambda x: x IS NOT NULL) AS codes FROM t)"""),
)
def job09_all_rules(spark, d):
    """All ten rule sets on one match; a tools completed, b degraded."""
    a, b = F.col("a"), F.col("b")
    points, codes = E.adjustments(all_rules())
    t = _t(spark, d).select("id", "a", "b", L.round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points + 0.4))).alias("score"), codes.alias("found"))
    sure = L.round4(E.confidence(F.col("score"), a, b, F.size("found")))
    reasons = E.merged_reasons(F.array(F.lit("lexical_similarity")), F.col("found"))
    return t.select("id", "score", F.array_join("found", ",").alias("codes"), sure.alias("confidence"), F.array_join(reasons, ",").alias("reasons"))


def all_rules() -> list[E.Rule]:
    """The ten rule sets over columns k, a, b and c, from which the tools' findings derive."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return [
        *E.whois_rules(F.col("k")), *E.dns_rules(a == 0, b == 0, c == 0), *E.http_rules(_status(), F.when(b > 2, "https://x/").otherwise("http://x/")),
        *E.page_rules(F.when(b == 0, "parked").when(b == 1, "challenge").otherwise("live"), c < 3, V._pick(_LEVELS, a)), *E.email_rules(V._pick(_LEVELS, a)),
        *E.geo_rules(V._pick(("RU", "IR", "DE", "BR", "US"), a), F.when(b == 3, "DDoS-Guard LTD").otherwise("Some Host")), *E.ssl_rules(a == 4), *E.safe_browsing_rules(b == 2),
        *E.feed_rules(a == 0, b == 0, c < 5), *E.clone_rules(a == 0, c / 10.0),
    ]


@query("FN25_parse_datetime", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def fn25(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "no date").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return V.table(spark, d, "events").select("event_id", F.try_to_timestamp(raw).cast("timestamp_ntz").alias("at"))


@query("SET06_array_intersections", _sql("SELECT id, a = b OR a = c AS overlap, array_to_string(list_sort(list_distinct(list_intersect([a, b], [b, c]))), ',') AS both FROM t"))
def set06(spark, d):
    x, y = F.array("a", "b"), F.array("b", "c")
    return _t(spark, d).select("id", ((F.col("a") == F.col("b")) | (F.col("a") == F.col("c"))).alias("overlap"), F.array_join(F.transform(F.array_sort(F.array_intersect(x, y)), lambda v: v.cast("string")), ",").alias("both"))
