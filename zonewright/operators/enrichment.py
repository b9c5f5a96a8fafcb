"""Rules over tool results: score adjustments, ownership, page risk, domain health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, float, str]

# Countries whose hosting raises the score.
RISKY_COUNTRIES = ("RU", "BY", "KP", "IR")


def first_true(*cases: tuple[Column, str], other: str) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(other)


def adjustments(rules: list[Rule]) -> tuple[Column, Column]:
    """(sum of the points, codes in order) of the rules that hold; null conditions don't."""
    on = [F.coalesce(cond, F.lit(False)) for cond, _, _ in rules]
    points = reduce(lambda a, b: a + b, [F.when(c, F.lit(p)).otherwise(F.lit(0.0)) for c, (_, p, _) in zip(on, rules, strict=True)])
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, (_, _, code) in zip(on, rules, strict=True)]))
    return points, codes


def whois_rules(age: Column) -> list[Rule]:
    return [(age <= 30, 0.18, "recent_registration"), ((age > 30) & (age <= 90), 0.10, "fresh_registration")]


def dns_rules(has_a: Column, has_aaaa: Column, has_mx: Column) -> list[Rule]:
    return [(~has_a & ~has_aaaa & ~has_mx, -0.08, "no_active_dns"), (~has_a & ~has_aaaa & has_mx, 0.12, "mail_only_infrastructure")]


def http_rules(status: Column, final_url: Column) -> list[Rule]:
    return [(status == 200, 0.05, "live_http_service"), (status.isin(401, 403, 429, 503), 0.06, "restricted_live_service"), (F.startswith(final_url, F.lit("https://")), 0.03, "https_live")]


def page_rules(disposition: Column, credentials: Column, level: Column) -> list[Rule]:
    return [
        (disposition == "parked", -0.22, "parked_page"), (disposition == "challenge", 0.05, "challenge_page"), (credentials, 0.26, "credential_collection_surface"),
        (level == "critical", 0.22, "critical_page_risk"), (level == "high", 0.14, "high_page_risk"), (level == "medium", 0.06, "medium_page_risk"), (level == "low", 0.04, "low_page_risk"),
    ]


def email_rules(spoofing: Column) -> list[Rule]:
    return [(spoofing == "critical", 0.16, "mail_spoofing_critical"), (spoofing == "high", 0.09, "mail_spoofing_high")]


def geo_rules(country: Column, provider: Column) -> list[Rule]:
    return [(country.isin(*RISKY_COUNTRIES), 0.12, "risky_hosting_country"), (F.contains(F.lower(provider), F.lit("ddos-guard")), 0.08, "bulletproof_hosting")]


def ssl_rules(revoked: Column) -> list[Rule]:
    return [(revoked, 0.25, "certificate_revoked")]


def safe_browsing_rules(listed: Column) -> list[Rule]:
    return [(listed, 0.30, "safe_browsing_listed")]


def feed_rules(urlhaus: Column, phishtank: Column, verified: Column) -> list[Rule]:
    return [(urlhaus, 0.20, "urlhaus_listed"), (phishtank & verified, 0.28, "phishtank_verified"), (phishtank & ~verified, 0.12, "phishtank_unverified")]


def clone_rules(is_clone: Column, similarity: Column) -> list[Rule]:
    strong = F.coalesce(is_clone, F.lit(False)) | F.coalesce(similarity >= 0.75, F.lit(False))
    return [(strong, 0.20, "website_clone"), (~strong & (similarity >= 0.5), 0.10, "website_similar")]


def confidence(score: Column, completed: Column, degraded: Column, signals: Column) -> Column:
    return F.greatest(F.lit(0.15), F.least(F.lit(1.0), score * 0.7 + completed * 0.04 - degraded * 0.08 + signals * 0.01))


def delivery_risk(spoofing: Column) -> Column:
    return F.when(spoofing == "critical", "high").when(spoofing == "high", "possible").otherwise("none")


def merged_reasons(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(old, new)))


def with_tld(name: Column, tld: Column) -> Column:
    dot = F.concat(F.lit("."), tld)
    return F.when(F.endswith(name, dot), name).otherwise(F.concat(name, dot))


def auto_enrich(rule: Column, seed_type: Column, bucket: Column, score: Column, risk: Column) -> Column:
    """Whether a match is looked into without being asked for."""
    return (
        F.when(bucket == "watchlist", False)
        .when(rule.isin("typo_candidate", "homograph", "brand_plus_keyword"), True)
        .when((rule == "exact_label_match") & (seed_type == "domain_label"), True)
        .when(bucket == "defensive_gap", score >= 0.55)
        .otherwise((score >= 0.72) & risk.isin("high", "critical"))
    )


def page_text(html: Column) -> Column:
    """Visible text: without scripts, styles and tags, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


# Words of parked pages and of pages that ask for credentials.
PARKED_WORDS = ("domain is for sale", "buy this domain", "parked free", "domain parking")
CREDENTIAL_WORDS = ("password", "sign in", "log in", "verify your account")


def page_risk(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) with title, counts of forms, inputs and password fields, score and level."""
    html = F.coalesce("html", F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all(html, F.lit(p), F.lit(0)))
    text = F.lower(page_text(html))
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    rows = pages.select(
        "page_id", F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), count(r"(?i)<form[\s>]").alias("forms"), count(r"(?i)<input[\s>]").alias("inputs"),
        count(r"(?i)<input[^>]*type=.?password").alias("passwords"), count(r"(?i)<script[\s>]").alias("scripts"), F.length(text).alias("chars"),
        any_of(PARKED_WORDS).alias("parked"), any_of(CREDENTIAL_WORDS).alias("asks"),
    )
    score = F.when(F.col("passwords") > 0, 0.5).otherwise(0.0) + F.when(F.col("asks"), 0.2).otherwise(0.0) + F.when(F.col("forms") > 0, 0.1).otherwise(0.0) - F.when(F.col("parked"), 0.3).otherwise(0.0)
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), score))
    return rows.withColumn("level", F.when(F.col("score") >= 0.7, "critical").when(F.col("score") >= 0.5, "high").when(F.col("score") >= 0.2, "medium").when(F.col("score") > 0, "low").otherwise("none"))


def health_status(checks: list[tuple[Column, str]]) -> Column:
    """The worst of three-valued checks: critical, warning, healthy; unknown where none was made."""
    unknown = reduce(lambda a, b: a & b, [c.isNull() for c, _ in checks])
    bad = lambda kind: reduce(lambda a, b: a | b, [F.coalesce(~c, F.lit(False)) for c, k in checks if k == kind])
    return F.when(bad("critical"), "critical").when(bad("warning"), "warning").when(unknown, "unknown").otherwise("healthy")
