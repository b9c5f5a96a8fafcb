"""What a web page gives away: parked, protected, asking for credentials, imitating a brand, or made by a phishing kit.

Tags are found by patterns; script and style never count as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from . import enrichment as E
from . import triage as T

# Terms that ask for credentials; three different ones count.
CREDENTIAL_TERMS = (
    "password", "senha", "login", "sign in", "sign-in", "signin", "log in", "log-in", "entrar", "acessar", "authenticate", "username", "usuário",
    "email", "cpf", "cnpj", "cartão", "credit card", "card number", "cvv", "ssn", "social security", "bank account", "conta bancária",
)
# Brands that pages imitate.
BRANDS = (r"banco\s*(do\s*brasil|itau|bradesco|santander|caixa|nubank)", "correios", r"receita\s*federal", r"gov\.br")
# Language that presses the reader.
URGENCY_TERMS = (
    "your account has been", "sua conta foi", "verify your", "verifique sua", "suspended", "suspens", "unauthorized", "não autorizado", "immediately", "imediatamente",
    "expires today", "expira hoje", "act now", "aja agora", "limited time", "tempo limitado", "click here", "clique aqui",
)
# Phrases of parked pages, and of pages behind a challenge.
PARKED = ("this domain is for sale", "buy this domain", "domain for sale", "parked free", "parked domain", "afternic", "sedo", "dan.com", "undeveloped")
CHALLENGE = ("access denied", "attention required", "checking your browser", "ddos-guard", "cloudflare", "temporarily unavailable", "service unavailable")
# Paths and phrases of phishing kits.
KIT_PATHS = ("/__utm.gif", "/__open.gif", "/track/open", "/track/click", "/panel/login", "/admin/login.php", "/admin/index.php", "/cp/login", "/api/collect", "/api/submit", "/api/capture", "/submit.php", "/gate.php")
KIT_PHRASES = ("evilginx", "modlishka", "robin banks", "darcula", "collectdata(", "sendtogate(", "exfil(")
# What a signal of each severity adds.
SEVERITY = {"critical": 0.40, "high": 0.25, "medium": 0.15, "low": 0.05}
BLOCKED = (401, 403, 429, 503)
MANY_RESOURCES = 20


def _any(texts: list[Column], phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for t in texts for p in phrases])


def _how_many(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in phrases])


def page_signals(pages: DataFrame) -> DataFrame:
    """pages (page_id, target, final_url, html, status, server) with disposition, signals (category and severity), score,
    level, confidence and data quality. Without html a page is unreachable and says nothing."""
    html = F.coalesce("html", F.lit(""))
    text, title = F.lower(E.page_text(html)), F.lower(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    url, server = F.lower(F.coalesce("final_url", F.lit(""))), F.lower(F.coalesce("server", F.lit("")))
    forms = F.regexp_extract_all(html, F.lit(r"(?is)<form[\s>].*?</form>"), F.lit(0))
    login = F.filter(forms, lambda f: F.regexp_like(f, F.lit(r"(?i)<input[^>]*type=[\"']?password")))
    actions = F.transform(login, lambda f: F.regexp_extract(f, r"(?is)^<form[^>]*?action\s*=\s*[\"']?([^\"'\s>]*)", 1))
    loaded = F.regexp_extract_all(html, F.lit(r"(?i)<(?:script|link|img)\s[^>]*?(?:src|href)\s*=\s*[\"']?(http[^\"'\s>]*)"), F.lit(1))
    rows = pages.select("*", text.alias("__text"), title.alias("__title"), url.alias("__url"), server.alias("__server"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)<input[^>]*type=[\"']?password"), F.lit(0))).alias("__passwords"), actions.alias("__actions"), loaded.alias("__loaded"))
    c = F.col
    # Each phrase list is looked through once; the signals below only combine the answers.
    rows = rows.select(
        "*", _any([c("__title"), c("__url"), c("__text")], PARKED).alias("__parked"), _any([c("__title"), c("__url"), c("__text"), c("__server")], CHALLENGE).alias("__challenge"),
        _how_many(c("__text"), CREDENTIAL_TERMS).alias("__terms"), _any([c("__text")], URGENCY_TERMS).alias("__urgent"), F.coalesce(c("status").isin(*BLOCKED), F.lit(False)).alias("__blocked"),
        F.array_compact(F.array(*[F.nullif(F.regexp_extract(F.concat_ws(" ", "__title", "__text"), b, 0), F.lit("")) for b in BRANDS])).alias("__brands"),
        (_any([F.coalesce(F.try_parse_url(c("__url"), F.lit("PATH")), F.lit(""))], KIT_PATHS) | _any([c("__text")], KIT_PHRASES)).alias("__kit"),
        F.size(F.filter("__actions", lambda a: (a != "") & ~F.startswith(a, F.lit("/")))).alias("__posts"), F.size(F.filter("__loaded", lambda u: ~F.contains(u, c("target")))).alias("external_count"),
    )
    label = L.registrable_label(F.lower("target"))
    # The first brand of each pattern counts where the name doesn't hold it.
    imitates = F.exists("__brands", lambda b: ~F.contains(F.coalesce(label, F.lit("")), b)) & ((c("__passwords") > 0) | c("__urgent"))
    signal = lambda cond, category, severity: F.when(cond, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    posts = F.transform(F.sequence(F.lit(1), F.greatest(c("__posts"), F.lit(1))), lambda i: signal(c("__posts") > 0, "credential_harvesting", "critical"))
    signals = F.array_compact(F.concat(
        F.array(signal(c("__parked"), "parked_domain", "low"), signal(c("__challenge") | c("__blocked"), "protected_page", "medium"), signal(F.contains(c("__server"), F.lit("ddos-guard")), "infrastructure_masking", "medium"), signal(c("__passwords") > 0, "credential_harvesting", "high")),
        posts,
        F.array(signal(c("__terms") >= 3, "credential_harvesting", "medium"), signal(c("__urgent"), "social_engineering", "medium"), signal(imitates, "brand_impersonation", "high"), signal(c("__kit"), "phishing_kit_infrastructure", "high"), signal(c("external_count") > MANY_RESOURCES, "resource_loading", "low")),
    ))
    reached = c("html").isNotNull()
    of = lambda s: F.when(s["severity"] == "critical", 40).when(s["severity"] == "high", 25).when(s["severity"] == "medium", 15).otherwise(5)
    hundredths = F.aggregate("signals", F.lit(0), lambda a, s: a + of(s))
    rows = rows.withColumn("signals", F.when(reached, signals).otherwise(F.slice(signals, 1, 0)))
    rows = rows.withColumn("score", F.least(F.lit(100), hundredths) / 100.0)
    rows = rows.withColumn("disposition", F.when(~reached, "unreachable").when(c("__parked"), "parked").when(c("__challenge") | c("__blocked"), "challenge").otherwise("live"))
    level = F.when(~reached, "inconclusive").when(c("score") >= 0.7, "critical").when(c("score") >= 0.5, "high").when(c("score") >= 0.3, "medium").when(c("score") > 0, "low").when(c("disposition") == "challenge", "protected").otherwise("safe")
    confidence = F.when(~reached, 0.0).when(c("disposition") == "challenge", 0.45).otherwise(0.85)
    quality = F.when(~reached, "inconclusive").when(c("disposition") == "challenge", "degraded").otherwise("complete")
    return rows.select("page_id", "disposition", "signals", "score", level.alias("level"), (reached & (F.size("__actions") > 0)).alias("has_login_form"), (reached & (c("__passwords") > 0)).alias("has_credential_inputs"), (reached & c("__kit")).alias("has_phishing_kit"), F.when(reached, c("external_count")).otherwise(0).alias("external_count"), confidence.alias("confidence"), quality.alias("data_quality"))


def host_of(url: Column) -> Column:
    return T.host_of(url)
