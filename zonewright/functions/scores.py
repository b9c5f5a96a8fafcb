"""Similarity scores, risk and triage of one name against one brand or seed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L

# Words that raise the risk beside a brand.
RISK_WORDS = (
    "account", "alert", "auth", "bank", "billing", "confirm", "help", "login", "official", "password",
    "payment", "recover", "reset", "secure", "signin", "support", "transfer", "update", "verify", "wallet",
)
# Weight of a seed by the channel it belongs to, and for any other channel.
CHANNELS = {"registrable_domain": 1.00, "certificate_hostname": 0.85, "associated_brand": 0.75, "both": 0.90}
OTHER_CHANNEL = 0.75
# Endings where a defensive registration matters.
STRATEGIC = (
    "com", "net", "org", "app", "io", "ai", "co", "xyz", "site", "store",
    "online", "shop", "info", "biz", "cloud", "dev", "pro", "com.br", "net.br", "org.br",
)
# Least score of a match by noise mode, and for any other mode.
NOISE = {"conservative": 0.60, "standard": 0.50, "broad": 0.42}
OTHER_NOISE = 0.40


def choose(pairs: dict, key: Column, other) -> Column:
    return reduce(lambda w, kv: w.when(key == kv[0], kv[1]), list(pairs.items())[1:], F.when(key == next(iter(pairs)), next(iter(pairs.values())))).otherwise(other)


def present(*items: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in items]))


@dataclass
class Signals:
    """The separate scores of a label against a brand, each between 0 and 1."""

    trigram: Column
    edit: Column
    brand: Column
    keyword: Column
    homograph: Column
    exact: Column


def risk_words(plain: Column) -> Column:
    """The RISK_WORDS that a label without look-alikes holds: none but these can be left beside a brand."""
    held = F.filter(F.array(*map(F.lit, RISK_WORDS)), lambda w: F.contains(plain, w))
    return F.when(F.rlike(plain, F.lit("|".join(RISK_WORDS))), held).otherwise(F.array().cast("array<string>"))


def signals(label: Column, brand: Column, keywords: Column, trigram: Column, plain: Column | None = None, base: Column | None = None, risky: Column | None = None, keys: Column | None = None, homograph: Column | None = None) -> Signals:
    """plain: the label with look-alikes replaced, where ASCII ones aren't all or it is at hand; base: the brand so; risky: risk_words(plain), keys: tidy_keywords(keywords), homograph: closeness(plain, base), where at hand."""
    if base is None:
        base = L.unmasked(brand)
    if plain is None:
        plain = L.unmasked(label)
    if homograph is None:
        homograph = L.closeness(plain, base)
    # Most labels and brands hold no look-alike: one distance is both.
    edit = F.when((label == plain) & (brand == base), homograph).otherwise(F.greatest(L.closeness(label, brand), homograph))
    risk = L.tidy_keyword_hits(plain, base, F.array(*map(F.lit, RISK_WORDS)) if risky is None else risky)
    own = L.keyword_hits(plain, base, keywords) if keys is None else L.tidy_keyword_hits(plain, base, keys)
    return Signals(trigram, edit, L.brand_boundary(plain, base).cast("double"), F.least(F.lit(1.0), risk * 0.3 + own * 0.2), homograph, label == brand)


def composite(s: Signals) -> Column:
    return s.trigram * 0.30 + s.edit * 0.25 + s.brand * 0.20 + s.keyword * 0.15 + s.homograph * 0.10


def risk_level(s: Signals, score: Column) -> Column:
    named = ~s.exact & (s.brand == 1) & (s.keyword >= 0.3) & (score >= 0.55)
    return F.when(s.exact & (s.keyword == 0), "high").when(named | (score >= 0.9), "critical").when(score >= 0.72, "high").when(score >= 0.5, "medium").otherwise("low")


def conditions(s: Signals) -> dict[str, Column]:
    """The reasons, in order, and when they hold."""
    return {
        "exact_label_match": s.exact,
        "typosquatting": ~s.exact & (s.edit >= 0.75) & (s.trigram >= 0.45),
        "brand_containment": (s.brand >= 1) & ~s.exact,
        "risky_keywords": s.keyword > 0,
        "homograph_attack": ~s.exact & (s.homograph >= 0.95) & (s.homograph > s.trigram),
    }


def reasons(s: Signals) -> Column:
    found = present(*[(cond, name) for name, cond in conditions(s).items()])
    return F.when(F.size(found) == 0, F.array(F.lit("lexical_similarity"))).otherwise(found)


def seeded_score(base: Column, weight: Column, channel: Column) -> Column:
    return F.least(F.lit(1.0), base * 0.70 + weight * 0.20 + choose(CHANNELS, channel, OTHER_CHANNEL) * 0.10)


def seeded_risk(score: Column, why: Column | dict[str, Column], channel: Column) -> Column:
    """why: the reasons, or conditions() where signals are at hand."""
    more = F.when(channel == "certificate_hostname", 0.02).otherwise(0.0)
    has = lambda x: why[x] if isinstance(why, dict) else F.array_contains(why, x)
    return (
        F.when(has("exact_label_match") & (score >= 0.78), "high")
        .when(has("homograph_attack") & has("risky_keywords") & (score >= more + 0.60), "critical")
        .when(has("homograph_attack") & (score >= more + 0.58), "high")
        .when(has("brand_containment") & has("risky_keywords") & (score >= more + 0.64), "critical")
        .when(score >= more + 0.78, "high")
        .when(score >= more + 0.55, "medium")
        .otherwise("low")
    )


def matched_rule(why: Column, channel: Column) -> Column:
    has = lambda x: F.array_contains(why, x)
    return (
        F.when(has("exact_label_match"), "exact_label_match")
        .when(has("homograph_attack"), "homograph")
        .when(has("typosquatting"), "typo_candidate")
        .when(has("brand_containment") & has("risky_keywords"), "brand_plus_keyword")
        .when(has("brand_containment"), F.when(channel == "certificate_hostname", "hostname_containment").otherwise("brand_containment"))
        .otherwise("lexical_similarity")
    )


def noise_threshold(mode: Column) -> Column:
    return choose(NOISE, mode, OTHER_NOISE)


def generic_seed(seed_type: Column, seed: Column, brand: Column) -> Column:
    """A short alias that isn't the brand's own label."""
    return seed_type.isin("brand_alias", "brand_phrase", "brand_primary") & (F.length(F.trim(seed)) <= 5) & (F.lower(F.trim(seed)) != F.lower(F.trim(brand)))


def actionability(name: Column, tld: Column, score: Column, risk: Column, rule: Column, seed_type: Column, seed: Column, brand: Column, channel: Column, first_seen: Column, as_of: Column) -> tuple[Column, Column, Column]:
    """(score, bucket, reasons) of a match: how much it deserves attention on the day as_of."""
    age, generic = L.age_days(first_seen, as_of), generic_seed(seed_type, seed, brand)
    label = F.lower(F.substring_index(name, ".", 1))
    login = F.startswith(label, F.lit("login")) | F.endswith(label, F.lit("login"))
    exact = rule == "exact_label_match"
    parts = [
        (age <= 30, 0.18, "newly_observed_domain"),
        ((age > 30) & (age <= 90), 0.08, "recently_observed_domain"),
        (exact & (seed_type == "domain_label"), 0.32, "exact_match_on_official_label"),
        (exact & (seed_type != "domain_label") & generic, -0.12, "exact_match_on_generic_associated_seed"),
        (exact & (seed_type != "domain_label") & ~generic, 0.16, "exact_match_on_associated_brand"),
        (rule == "typo_candidate", 0.38, "typosquatting_pattern"),
        (rule == "homograph", 0.42, "homograph_pattern"),
        (rule == "brand_plus_keyword", 0.34, "brand_plus_risky_keyword"),
        ((rule == "brand_containment") & (channel == "associated_brand"), 0.04, "associated_brand_containment"),
        ((rule == "brand_containment") & (channel != "associated_brand"), 0.10, "official_label_containment"),
        (tld.isin(*STRATEGIC), 0.05, "strategic_tld"),
        (risk.isin("high", "critical"), 0.10, None),
        (generic, -0.10, None),
        (login, 0.10, "login_keyword_in_label"),
    ]
    total = score * 0.35
    for cond, points, _ in parts:
        total = total + F.when(cond, points).otherwise(0.0)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    bucket = (
        F.when(rule.isin("typo_candidate", "homograph", "brand_plus_keyword") & (total >= 0.68), "immediate_attention")
        .when(exact & (seed_type == "domain_label"), "defensive_gap")
        .when((total >= 0.72) & risk.isin("high", "critical"), "immediate_attention")
        .when(total >= 0.48, "defensive_gap")
        .otherwise("watchlist")
    )
    why = F.array_sort(F.array_distinct(present(*[(c, n) for c, _, n in parts if n])))
    return L.round4(total), bucket, why


def disposition_of(bucket: Column) -> Column:
    return F.when(bucket == "immediate_attention", "live_but_unknown").when(bucket == "defensive_gap", "defensive_gap").otherwise("inconclusive")
