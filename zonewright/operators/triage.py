"""What becomes of a match once tools have looked at it: ownership, bucket, disposition, dismissal, advice; and the
health of official domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S

# Signals of a live threat, and classes of ownership that end triage.
LIVE_THREATS = ("credential_collection_surface", "brand_impersonation_content", "clone_detected")
OWNED = ("official", "self_owned_related", "self_owned_registrant", "confirmed_owned")
# Rules of look-alike names.
LOOKALIKE_RULES = ("typo_candidate", "homograph", "brand_plus_keyword")
# Tools whose failure says nothing about a domain.
OPTIONAL_TOOLS = ("screenshot", "ssl_check")
# Page risk levels that are no finding.
HARMLESS_LEVELS = ("safe", "inconclusive", "protected")


def _any(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def ownership(domain: Column, tld: Column, official: Column, brand_names: Column, registrants: Column, registrant_id: Column, organization: Column, email: Column, confirmed: Column, tax_ids: Column, org_names: Column, email_domains: Column, final_url: Column, sans: Column, created: Column, as_of: Column) -> Column:
    """The first class that holds: official, confirmed_owned, self_owned_related, self_owned_registrant,
    third_party_legitimate (registered for over a year), third_party_unknown.

    official: registrable domains of the brand. brand_names: its label and names, raw. registrants: organization and
    name from the registry. The last arrays are what the brand's owner has declared. Nulls hold nothing.
    """
    name = F.lower(domain)
    full = F.when(F.endswith(name, F.concat(F.lit("."), tld)), name).otherwise(F.concat_ws(".", name, tld))
    # Short names say too little.
    tokens = F.filter(F.transform(brand_names, L.brand_text), lambda t: F.length(t) >= 4)
    overlap = lambda text, names: (F.length(text) > 0) & _any(names, lambda t: (F.length(t) > 0) & (F.contains(text, t) | F.contains(t, text)))
    related = _any(registrants, lambda r: overlap(L.brand_text(r), tokens))
    same_id = (F.length(L.registrant_id(registrant_id)) > 0) & _any(tax_ids, lambda x: L.registrant_id(x) == L.registrant_id(registrant_id))
    same_org = overlap(L.brand_text(organization), F.transform(org_names, L.brand_text))
    at = F.when(F.contains(email, F.lit("@")), F.lower(F.substring_index(email, "@", -1)))
    same_mail = _any(email_domains, lambda x: F.lower(F.ltrim(x, F.lit("@"))) == at) | F.coalesce(F.array_contains(official, at), F.lit(False))
    registrable = lambda x: L.registrable_domain(F.lower(x))
    redirects = F.coalesce(F.array_contains(official, registrable(host_of(final_url))), F.lit(False))
    # Wildcards are left out: shared certificates have them.
    named = F.transform(F.filter(sans, lambda x: ~F.startswith(x, F.lit("*."))), registrable)
    certified = F.coalesce(F.arrays_overlap(F.array_compact(named), F.array_compact(F.transform(official, registrable))), F.lit(False))
    return (
        F.when(F.array_contains(official, full) | F.array_contains(official, name), "official")
        .when(related, "self_owned_related")
        .when(F.array_contains(confirmed, full) | F.array_contains(confirmed, name), "confirmed_owned")
        .when(same_id | F.coalesce(same_org, F.lit(False)) | same_mail, "self_owned_registrant")
        .when(redirects | certified, "self_owned_related")
        .when(F.datediff(as_of, created) > 365, "third_party_legitimate")
        .otherwise("third_party_unknown")
    )


def has_threat(codes: Column) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, LIVE_THREATS)))


# Advice after enrichment; {0} is the name, {1} the brand.
AFTER = {
    "owned": "{0} appears to be an official or self-owned asset of {1}. Suppressed from frontline triage.",
    "threat": "{0} shows live impersonation, credential-capture, or clone signals targeting {1}. Investigate immediately.",
    "lexical": "{0} scored high on both lexical similarity and enrichment signals for {1}. Likely a live threat.",
    "parked": "{0} exactly matches a {1} label but is parked. Assess for defensive registration before it activates.",
    "moderate": "{0} shows moderate similarity to {1} after enrichment. Review for ownership gap or escalation.",
    "low": "{0} shows low post-enrichment signal for {1}. Keep in watchlist unless analyst flags new concern.",
}
# Advice before enrichment.
BEFORE = {
    "homograph": "{0} uses look-alike characters to mimic {1}. Inspect for active phishing infrastructure immediately.",
    "typo_candidate": "{0} is a likely typosquatting variant of {1}. Check for live content or credential-capture surfaces.",
    "brand_plus_keyword": "{0} combines {1}'s name with a high-risk keyword. Verify whether this domain is being used to impersonate the brand.",
    "exact": "{0} exactly matches a registered label of {1} but is not an official asset. Assess for defensive registration or legal action.",
    "high": "{0} scores high similarity to {1} with elevated risk signals. Inspect immediately for active impersonation or phishing.",
    "moderate": "{0} shows moderate similarity to {1}. Monitor closely and assess whether defensive registration or escalation is warranted.",
    "low": "{0} shows low-confidence similarity to {1}. Keep in watchlist unless enrichment data adds operational concern.",
    "generic": "{0} is a weak match on a short associated-brand term for {1}. Keep only for background monitoring unless new signals emerge.",
}


def sentence(template: str, name: Column, brand: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{1}"), brand), F.lit("{0}"), name)


def bucket_after(owner: Column, codes: Column, score: Column, rule: Column, seed_type: Column, name: Column, brand: Column) -> tuple[Column, Column]:
    """(bucket, advice) of a match after enrichment."""
    cases = [
        (owner.isin(*OWNED), "watchlist", "owned"),
        (has_threat(codes), "immediate_attention", "threat"),
        ((score >= 0.80) & rule.isin(*LOOKALIKE_RULES), "immediate_attention", "lexical"),
        (F.array_contains(codes, "parked_or_for_sale_page") & (rule == "exact_label_match") & (seed_type == "domain_label"), "defensive_gap", "parked"),
        (score >= 0.55, "defensive_gap", "moderate"),
    ]
    pick = lambda value: reduce(lambda w, c: w.when(c[0], value(c)), cases[1:], F.when(cases[0][0], value(cases[0])))
    return pick(lambda c: F.lit(c[1])).otherwise("watchlist"), pick(lambda c: sentence(AFTER[c[2]], name, brand)).otherwise(sentence(AFTER["low"], name, brand))


def disposition_after(owner: Column, codes: Column, delivery: Column, page: Column, page_status: Column, statuses: Column, score: Column) -> Column:
    """statuses: map from tool to its status. Without data a match is never called live."""
    told = F.filter(F.map_entries(statuses), lambda x: ~x["key"].isin(*OPTIONAL_TOOLS))
    failed = F.forall(told, lambda x: F.coalesce(x["value"] != "completed", F.lit(True)))
    return (
        F.when(owner == "official", "official")
        .when(owner.isin("self_owned_related", "self_owned_registrant"), "safe")
        .when(owner == "third_party_legitimate", "third_party_legitimate")
        .when(has_threat(codes), "likely_phishing")
        .when(delivery == "high", "mail_spoofing_risk")
        .when(page == "parked", "defensive_gap")
        .when(failed | F.coalesce(page_status != "completed", F.lit(True)) | F.coalesce(page == "unreachable", F.lit(False)), "inconclusive")
        .when(score >= 0.72, "live_but_unknown")
        .otherwise("inconclusive")
    )


def recommended_action(name: Column, brand: Column, rule: Column, seed_type: Column, risk: Column, score: Column, bucket: Column, generic: Column) -> Column:
    """Advice on a match before tools have looked at it; score is its actionability."""
    say = lambda key: sentence(BEFORE[key], name, brand)
    sharp = rule.isin(*LOOKALIKE_RULES) & (score >= 0.68)
    return (
        F.when((bucket == "watchlist") & generic, say("generic"))
        .when(sharp & (rule == "homograph"), say("homograph"))
        .when(sharp & (rule == "typo_candidate"), say("typo_candidate"))
        .when(sharp, say("brand_plus_keyword"))
        .when((rule == "exact_label_match") & (seed_type == "domain_label"), say("exact"))
        .when((score >= 0.72) & risk.isin("high", "critical"), say("high"))
        .when(score >= 0.48, say("moderate"))
        .otherwise(say("low"))
    )


def auto_disposition(owner: Column, score: Column, severities: Column, rule: Column, has_records: Column, has_mx: Column, age_days: Column, page_type: Column, listed: Column) -> Column:
    """self_owned, or the rule by which a match is dismissed without review; null where it stays."""
    serious = F.arrays_overlap(severities, F.array(F.lit("critical"), F.lit("high")))
    return (
        F.when(owner.isin(*OWNED), "self_owned")
        .when((score < 0.35) & ~serious & (F.coalesce(rule, F.lit("")) != "exact_label_match"), "low_score_post_enrichment")
        .when(~has_records & ~has_mx & (age_days > 365) & ~serious, "dead_domain")
        .when(page_type.isin("parked", "for_sale") & ~has_mx & ~listed, "parked_for_sale")
    )


def search_disposition(is_official: Column, reasons: Column, tld: Column, score: Column) -> Column:
    exact = F.array_contains(reasons, "exact_label_match") & tld.isin(*S.STRATEGIC)
    return F.when(is_official, "official").when(exact, "defensive_gap").when(score >= 0.72, "live_but_unknown").otherwise("watchlist")


# Schemas of the tools' results, as far as health needs them.
HEALTH_TOOLS = {
    "dns_lookup": "records array<struct<type string>>",
    "ssl_check": "is_valid boolean, certificate struct<days_remaining int, ocsp_status string>",
    "http_headers": "security_headers array<struct<present boolean>>",
    "email_security": "spoofing_risk string",
    "subdomain_takeover": "vulnerable_subdomains array<string>",
    "blacklist_check": "listed_count int",
    "safe_browsing": "threats array<string>",
    "urlhaus": "listed boolean",
    "phishtank": "in_database boolean",
    "suspicious_page": "risk_level string",
}


def health_fields(results: dict[str, Column]) -> dict[str, Column]:
    """Twelve nullable fields from the JSON results of ten tools; null where a tool gave nothing."""
    r = {tool: F.from_json(raw, HEALTH_TOOLS[tool]) for tool, raw in results.items()}
    # A result without fields is none.
    told = {tool: raw.isNotNull() & (F.regexp_replace(raw, r"\s", "") != "{}") for tool, raw in results.items()}
    got = lambda tool, value: F.when(told[tool], value)
    some = lambda items: F.coalesce(F.size(items), F.lit(0)) > 0
    ssl, headers, spoof = r["ssl_check"], r["http_headers"]["security_headers"], r["email_security"]["spoofing_risk"]
    # The risk is a word, or an object with its level.
    level = F.when(F.startswith(spoof, F.lit("{")), F.get_json_object(spoof, "$.level")).otherwise(spoof)
    present, total = F.size(F.filter(headers, lambda h: F.coalesce(h["present"], F.lit(False)))), F.size(headers)
    return {
        "dns_ok": got("dns_lookup", some(r["dns_lookup"]["records"])),
        "ssl_ok": got("ssl_check", F.coalesce(ssl["is_valid"], F.lit(False)) & (F.coalesce(ssl["certificate"]["ocsp_status"], F.lit("unknown")) != "revoked")),
        "ssl_days_remaining": got("ssl_check", ssl["certificate"]["days_remaining"]),
        "email_security_ok": got("email_security", F.coalesce(level.isin("none", "low"), F.lit(False))),
        "spoofing_risk": got("email_security", level),
        "headers_score": got("http_headers", F.when(total > 0, F.when(present == total, "good").when(present >= F.floor(total / 2), "partial").otherwise("poor"))),
        "takeover_risk": got("subdomain_takeover", some(r["subdomain_takeover"]["vulnerable_subdomains"])),
        "blacklisted": got("blacklist_check", F.coalesce(r["blacklist_check"]["listed_count"], F.lit(0)) > 0),
        "safe_browsing_hit": got("safe_browsing", some(r["safe_browsing"]["threats"])),
        "urlhaus_hit": got("urlhaus", F.coalesce(r["urlhaus"]["listed"], F.lit(False))),
        "phishtank_hit": got("phishtank", F.coalesce(r["phishtank"]["in_database"], F.lit(False))),
        "suspicious_content": got("suspicious_page", ~F.coalesce(r["suspicious_page"]["risk_level"], F.lit("safe")).isin(*HARMLESS_LEVELS)),
    }


def overall_status(f: dict[str, Column]) -> Column:
    """The worst of the fields: critical, warning, unknown (nothing was looked at), healthy."""
    yes = lambda *names: reduce(lambda a, b: a | b, [F.coalesce(f[n], F.lit(False)) for n in names])
    no = lambda name: F.coalesce(~f[name], F.lit(False))
    critical = yes("safe_browsing_hit", "urlhaus_hit", "phishtank_hit", "blacklisted", "suspicious_content") | no("ssl_ok")
    warning = no("email_security_ok") | yes("takeover_risk") | F.coalesce(f["headers_score"] == "poor", F.lit(False)) | F.coalesce(f["ssl_days_remaining"] < 30, F.lit(False))
    unknown = reduce(lambda a, b: a & b, [c.isNull() for c in f.values()])
    return F.when(critical, "critical").when(warning, "warning").when(unknown, "unknown").otherwise("healthy")


# Schemas of the tools' results, as far as their summaries need them.
SUMMARIES = {
    "dns_lookup": "records array<struct<type string>>, nameservers array<string>",
    "ssl_check": "is_valid boolean, certificate struct<issuer string, days_remaining int, san array<string>, ocsp_status string>",
    "http_headers": "status_code int, final_url string, server string",
    "email_security": "spoofing_risk string, mta_sts struct<mode string>",
    "suspicious_page": "risk_level string, page_disposition string, has_login_form boolean, has_credential_inputs boolean, has_phishing_kit_indicators boolean, data_quality string",
    "whois": "registrar string, creation_date string, registrant_country string, lookup_status string, availability_reason string",
    "screenshot": "screenshot_url string, page_title string, final_url string",
    "ip_geolocation": "country_code string, org string, asn string",
    "safe_browsing": "is_listed boolean, threat_types array<string>, skipped boolean",
    "urlhaus": "is_listed boolean, urls_count int, query_status string, skipped boolean",
    "phishtank": "in_database boolean, verified boolean, valid boolean",
}


def compact_summary(tool: Column, result: Column) -> Column:
    """The few fields of a tool's JSON result that are shown, as JSON; other tools' results stay whole."""
    said = {t: F.from_json(result, schema) for t, schema in SUMMARIES.items()}
    types = F.array_sort(F.array_distinct(F.transform(F.coalesce(said["dns_lookup"]["records"], F.array().cast("array<struct<type string>>")), lambda x: x["type"])))
    has = lambda t: F.array_contains(types, t)
    dns = F.struct(types.alias("record_types"), has("MX").alias("has_mx"), (has("A") | has("AAAA")).alias("has_a"), has("CAA").alias("has_caa"), F.coalesce(said["dns_lookup"]["nameservers"], F.array().cast("array<string>")).alias("nameservers"))
    cert = said["ssl_check"]["certificate"]
    ssl = F.struct(said["ssl_check"]["is_valid"].alias("is_valid"), cert["issuer"].alias("issuer"), cert["days_remaining"].alias("days_remaining"), F.greatest(F.size(cert["san"]), F.lit(0)).alias("san_count"), cert["ocsp_status"].alias("ocsp_status"))
    email = F.struct(said["email_security"]["spoofing_risk"].alias("spoofing_risk"), said["email_security"]["mta_sts"]["mode"].alias("mta_sts_mode"))
    made = {**said, "dns_lookup": dns, "ssl_check": ssl, "email_security": email}
    as_text = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    return reduce(lambda w, t: w.when(tool == t, as_text(made[t])), list(made)[1:], F.when(tool == "dns_lookup", as_text(dns))).otherwise(result)


def match_summary(brand: Column, name: Column, score: Column, actionability: Column, risk: Column, bucket: Column, rule: Column, reasons: Column, age_days: Column, record_types: Column, status: Column, final_url: Column, page: Column, page_risk: Column, spoofing: Column, country: Column, signals: Column) -> Column:
    """All evidence on one match as a JSON document; the field names are fixed values of its readers."""
    s = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    web = F.arrays_overlap(record_types, F.array(F.lit("A"), F.lit("AAAA")))
    return F.to_json(
        s(
            marca_monitorada=brand, dominio_suspeito=name, score_similaridade=L.round4(score), score_acionabilidade=L.round4(actionability), nivel_risco=risk, bucket_atencao=bucket, regra_deteccao=rule, motivos_deteccao=reasons,
            whois=s(idade_dias=age_days), dns=s(tipos_registros=record_types, tem_mx=F.array_contains(record_types, "MX"), tem_web=web), http=s(status_code=status, url_final=final_url), pagina=s(disposicao=page, nivel_risco=page_risk),
            email_seguranca=s(risco_spoofing=spoofing), geolocalizacao=s(pais=country), sinais_enriquecimento=signals,
        ),
        {"ignoreNullFields": "false"},
    )
