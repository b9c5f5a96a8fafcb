"""Brand profiles: official domains, aliases and keywords, and the seeds that a scan looks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S

# Weight of a seed by its type, and of any other type.
WEIGHTS = {
    "domain_label": 1.00, "hostname_stem": 0.95, "brand_primary": 0.90, "official_domain": 0.85, "brand_phrase": 0.80, "brand_alias": 0.65, "support_keyword": 0.20,
    "homograph_base": 0.85, "typo_base": 0.80, "combo_brand_keyword": 0.75, "combo_keyword_brand": 0.70, "semantic_brand": 0.60, "llm_combo": 0.72, "llm_semantic": 0.58, "llm_social_engineering": 0.68,
}
OTHER_WEIGHT = 0.50
# Words that abuse puts before and behind a brand.
PREFIXES = ("my", "meu", "portal", "acesso", "login", "painel", "app", "www", "secure", "oficial", "conta")
SUFFIXES = (
    "login", "online", "app", "web", "portal", "seguro", "oficial", "suporte", "help", "pay", "pagamento", "boleto",
    "fatura", "admin", "panel", "conta", "acesso", "reset", "verify", "update", "alert", "2via", "atendimento", "sac",
)
# Most combined seeds of a brand; seed types of a language model.
MOST_COMBOS = 120
MODEL_TYPES = ("llm_combo", "llm_semantic", "llm_social_engineering")
# Endings that go with any official domain under .br.
BRAZIL = ("br", "com.br", "net.br", "org.br")
# Noise modes, and the one that stands for none.
MODES, DEFAULT_MODE = ("conservative", "standard", "broad"), "standard"


def normalized_domain(x: Column) -> Column:
    return F.rtrim(F.lower(F.trim(x)), F.lit("."))


def _by_brand(rows: DataFrame, items: Column) -> DataFrame:
    """(brand_id, items): one row for each brand, with the items of all its rows.

    The rows are dealt out before anything is made of them: a small file is one task's, and what is made of its rows is many times larger.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "brand_id").select("brand_id", items.alias("items"))
    return dealt.groupBy("brand_id").agg(F.flatten(F.collect_list("items")).alias("items"))


def _firsts(items: Column, keys: tuple[str, ...]) -> Column:
    """The first of each key among items, structs of the keys, then what they are ordered by; nothing leaves the row."""
    key = lambda x: F.struct(*[x[k] for k in keys])
    return L.once(F.array_sort(items), lambda s: F.filter(s, lambda x, i: (i == 0) | ~key(F.get(s, i - 1)).eqNullSafe(key(x))))


def combo_seeds(brands: DataFrame, most: int = MOST_COMBOS) -> DataFrame:
    """(brand_id, seed_value, seed_type, base_weight, place): brand and keyword in both orders, risk words first, then
    the brand's keywords and suffixes, then prefixes; the first `most` different ones of each brand.

    brands: brand_id, cores (label and aliases, normalised), keywords.
    """
    words = F.array_distinct(F.concat(F.array(*map(F.lit, S.RISK_WORDS)), F.col("keywords"), F.array(*map(F.lit, SUFFIXES))))
    put = lambda value, kind, a, b: F.struct(L.brand_text(value).alias("seed_value"), F.lit(kind).alias("seed_type"), (a * 1000 + b).alias("at"))
    # Cores go before words: a number for the core, one for the word, one for the order of the two.
    pairs = L.once(words, lambda ws: F.flatten(F.transform("cores", lambda core, i: F.flatten(F.transform(ws, lambda w, j: F.array(put(F.concat(core, w), "combo_brand_keyword", i, 2 * j), put(F.concat(w, core), "combo_keyword_brand", i, 2 * j + 1)))))))
    led = F.flatten(F.transform("cores", lambda core, i: F.transform(F.array(*map(F.lit, PREFIXES)), lambda w, j: put(F.concat(w, core), "combo_keyword_brand", i + 1000, j))))
    made = F.filter(F.concat(pairs, led), lambda x: F.length(x["seed_value"]) >= 3)
    first = F.transform(_firsts(F.col("items"), ("seed_value", "seed_type")), lambda x: F.struct(x["at"], x["seed_value"], x["seed_type"]))
    rows = _by_brand(brands, made).select("brand_id", F.posexplode(F.slice(F.array_sort(first), 1, most)).alias("place", "s"))
    rows = rows.select("brand_id", "s.seed_value", "s.seed_type", (F.col("place") + 1).alias("place"))
    return rows.select("brand_id", "seed_value", "seed_type", S.choose(WEIGHTS, F.col("seed_type"), OTHER_WEIGHT).alias("base_weight"), "place")


def alias_inputs(brands: DataFrame) -> DataFrame:
    """(brand_id, value, normalized, type): primary name, aliases, phrases and keywords, the first of each normal form and type."""
    kinds = (("brand_primary", F.array("primary")), ("brand_alias", F.col("aliases")), ("brand_phrase", F.col("phrases")), ("support_keyword", F.col("keywords")))
    none = F.array().cast("array<string>")

    def typed(n: int, kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, none), lambda x, i: F.struct(L.brand_text(F.trim(x)).alias("normalized"), F.lit(kind).alias("type"), (i + 10_000 * n).alias("at"), F.trim(x).alias("value")))

    made = F.filter(F.concat(*[typed(n, kind, values) for n, (kind, values) in enumerate(kinds)]), lambda x: F.length(x["normalized"]) > 0)
    return _by_brand(brands, made).select("brand_id", F.inline(_firsts(F.col("items"), ("normalized", "type")))).select("brand_id", "value", "normalized", "type")


def profile_seeds(domains: DataFrame, aliases: DataFrame) -> DataFrame:
    """(brand_id, seed_value, seed_type, channel_scope, base_weight), each once.

    domains: brand_id, domain. aliases: as alias_inputs() returns them.
    """
    d = normalized_domain(F.col("domain"))
    seed = lambda value, kind, channel: F.struct(value.alias("seed_value"), F.lit(kind).alias("seed_type"), F.lit(channel).alias("channel_scope"))
    made = F.array(seed(L.brand_text(L.registrable_label(d)), "domain_label", "registrable_domain"), seed(d, "official_domain", "certificate_hostname"), seed(L.hostname_stem(d), "hostname_stem", "certificate_hostname"))
    channel = F.when(F.col("type") == "brand_primary", "both").otherwise("associated_brand")
    n = int(domains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out before repeats are looked for, as alias_inputs deals brands: a brand's seeds lie together, and no task meets those of a whole file.
    rows = domains.repartition(n, "brand_id").select("brand_id", F.inline(made)).unionByName(aliases.select("brand_id", F.col("normalized").alias("seed_value"), F.col("type").alias("seed_type"), channel.alias("channel_scope")))
    rows = rows.filter(F.length("seed_value") > 0).distinct()
    return rows.withColumn("base_weight", S.choose(WEIGHTS, F.col("seed_type"), OTHER_WEIGHT))


def profile_defaults(profiles: DataFrame) -> DataFrame:
    """profiles (brand_id, display, primary_name, explicit, mode) with display_name, primary, official, brand_label, noise_mode.

    Official domains are the explicit ones, or the display name if it is a domain; the primary name is the explicit
    one, the first domain's label, or the display name. A profile without any name has null for it; an unknown
    noise mode is null.
    """
    given = F.filter(F.coalesce("explicit", F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0)
    shown = normalized_domain(F.col("display"))
    is_domain = ~F.contains(shown, F.lit(" ")) & F.coalesce(L.registrable_domain(shown) == shown, F.lit(False))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = profiles.withColumn("official", F.when(F.size(given) > 0, given).when(is_domain, F.array("display")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("first_label", L.registrable_label(normalized_domain(F.get("official", 0))))
    rows = rows.withColumn("display_name", F.coalesce(blank("display"), blank("primary_name"))).withColumn("primary", F.coalesce(blank("primary_name"), "first_label", blank("display")))
    mode = F.coalesce(F.nullif(F.lower(F.trim("mode")), F.lit("")), F.lit(DEFAULT_MODE))
    return rows.withColumn("brand_label", F.coalesce("first_label", L.brand_text(F.col("primary")))).withColumn("noise_mode", F.when(mode.isin(*MODES), mode)).drop("first_label")


def brazilian_scope(scope: Column, official: Column) -> Column:
    """The scope with the endings that belong to official domains under .br; gov.br only where one is in use."""
    domains = F.transform(official, normalized_domain)
    uses = lambda ending: F.exists(domains, lambda d: F.endswith(d, F.lit(ending)))
    core = F.concat(scope, F.array_except(F.array(*map(F.lit, BRAZIL)), scope))
    gov = F.when(uses(".gov.br") & ~F.array_contains(scope, "gov.br"), F.array(F.lit("gov.br"))).otherwise(F.array().cast("array<string>"))
    return F.when(uses(".br"), F.concat(core, gov)).otherwise(scope)


def synced_cursors(cursors: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Scan cursors (brand_id, tld, scan_phase, watermark_day), set back to the start for brands whose official domains,
    (brand_id, domain) before and after an update, differ as sets."""
    of = lambda df, n: df.select("brand_id", normalized_domain(F.col("domain")).alias("domain")).distinct().withColumn(n, F.lit(1))
    differ = of(before, "b").join(of(after, "a"), ["brand_id", "domain"], "full").filter("a IS NULL OR b IS NULL").select("brand_id").distinct().withColumn("changed", F.lit(True))
    joined = cursors.join(differ, "brand_id", "left")
    reset = F.col("changed").isNotNull()
    return joined.select("brand_id", "tld", F.when(reset, "initial").otherwise(F.col("scan_phase")).alias("scan_phase"), F.when(~reset, F.col("watermark_day")).alias("watermark_day"))


def with_confirmed(trusted: Column, domain: Column) -> Column:
    """The JSON of a brand's trusted registrants with a domain appended to its confirmed ones."""
    schema = "cnpjs array<string>, org_names array<string>, email_domains array<string>, confirmed_domains array<string>"
    t = F.from_json(F.coalesce(trusted, F.lit("{}")), schema)
    return F.to_json(t.withField("confirmed_domains", F.array_append(F.coalesce(t["confirmed_domains"], F.array().cast("array<string>")), domain)))


# What a model's assessment must hold.
REQUIRED = ("risco_score", "categoria", "parecer_resumido", "principais_motivos", "recomendacao_acao", "confianca")


def parsed_response(raw: Column) -> Column:
    """A model's assessment as a struct; null where the text holds no object with all required keys.

    Fences of a code block are dropped; text around the outermost braces as well.
    """
    text = F.trim(raw)
    text = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(text, r"(?m)^```.*$", "")).otherwise(text)
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    keys = F.json_object_keys(found)
    whole = F.coalesce(F.forall(F.array(*map(F.lit, REQUIRED)), lambda k: F.array_contains(keys, k)), F.lit(False))
    x = F.from_json(found, "risco_score string, categoria string, parecer_resumido string, principais_motivos array<string>, recomendacao_acao string, confianca string")
    number = lambda c: c.try_cast("int")
    return F.when(whole, x.withField("risco_score", number(x["risco_score"])).withField("confianca", number(x["confianca"])))


def model_seeds(replies: DataFrame, most: int) -> DataFrame:
    """(brand_id, seed_value, seed_type, base_weight, place) from JSON replies (brand_id, reply): normalised, three letters or
    more, unknown types as llm_combo, the first of each value, at most `most`."""
    seeds = F.from_json("reply", "seeds array<struct<seed_value string, seed_type string>>")["seeds"]
    kind = lambda x: F.when(x["seed_type"].isin(*MODEL_TYPES), x["seed_type"]).otherwise("llm_combo")
    made = F.transform(seeds, lambda x, i: F.struct(L.brand_text(x["seed_value"]).alias("seed_value"), i.alias("at"), kind(x).alias("seed_type")))
    first = F.transform(_firsts(F.col("items"), ("seed_value",)), lambda x: F.struct(x["at"], x["seed_value"], x["seed_type"]))
    rows = _by_brand(replies, F.filter(made, lambda x: F.length(x["seed_value"]) >= 3)).select("brand_id", F.posexplode(F.slice(F.array_sort(first), 1, most)).alias("place", "s"))
    rows = rows.select("brand_id", "s.seed_value", "s.seed_type", (F.col("place") + 1).alias("place"))
    return rows.select("brand_id", "seed_value", "seed_type", S.choose(WEIGHTS, F.col("seed_type"), OTHER_WEIGHT).alias("base_weight"), "place")
