"""Queries on brand profiles; profiles derive from customers and suppliers, replies of models from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..operators import profiles as P
from . import views as V
from .register import query

_NONE = "array<string>"


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Profiles as their owners entered them: names and domains given, blank or missing by turns."""
    k, t = F.col("c_custkey"), F.col("c_custkey").cast("string")
    none = F.array().cast(_NONE)
    return V.table(spark, d, "customer").select(
        k.alias("brand_id"), F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.concat(F.lit("shop"), t, F.lit(".com.br"))).otherwise(F.col("c_name")).alias("display"),
        F.when(k % 3 == 0, F.concat(F.lit("Prime "), t)).alias("primary_name"),
        F.when(k % 5 == 0, none).when(k % 5 == 1, F.array(F.lit(" "), F.concat(F.lit("Shop"), t, F.lit(".GOV.BR.")))).otherwise(F.array(F.concat(F.lit("www.cust"), t, F.lit(".com")), F.concat(F.lit("cust"), t, F.lit(".com.br")))).alias("explicit"),
        V._pick(("Broad ", "", "loud", "conservative"), k % 4).alias("mode"), F.when(k % 2 == 0, F.array(F.lit("com"), F.lit("com.br"))).otherwise(F.array(F.lit("net"))).alias("scope"),
        F.concat(F.lit("Cust "), t).alias("primary"), F.array(F.concat(F.lit("cust-"), t), F.concat(F.lit("C"), t)).alias("aliases"), F.array(F.col("c_mktsegment"), F.lit("!!")).alias("phrases"), F.array(F.lit("pay"), F.lit("Pay"), F.lower("c_mktsegment")).alias("keywords"),
    )


_PROFILE = """pr AS (SELECT c_custkey AS brand_id, CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'shop' || c_custkey || '.com.br' ELSE c_name END AS display, CASE WHEN c_custkey % 3 = 0 THEN 'Prime ' || c_custkey END AS primary_name,
  CASE c_custkey % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [' ', 'Shop' || c_custkey || '.GOV.BR.'] ELSE ['www.cust' || c_custkey || '.com', 'cust' || c_custkey || '.com.br'] END AS explicit, (['Broad ','','loud','conservative'])[c_custkey % 4 + 1] AS mode,
  CASE WHEN c_custkey % 2 = 0 THEN ['com', 'com.br'] ELSE ['net'] END AS scope, 'Cust ' || c_custkey AS primary_given, ['cust-' || c_custkey, 'C' || c_custkey] AS aliases, [c_mktsegment, '!!'] AS phrases, ['pay', 'Pay', lower(c_mktsegment)] AS keywords FROM customer),
pd AS (SELECT *, CASE WHEN len(list_filter(explicit, lambda x: trim(x) <> '')) > 0 THEN list_filter(explicit, lambda x: trim(x) <> '') WHEN brand_id % 4 = 1 THEN [display] ELSE []::VARCHAR[] END AS official FROM pr)"""


def _norm(x: str) -> str:
    return f"rtrim(lower(trim({x})), '.')"


def _two(x: str) -> str:
    p = f"string_split({x}, '.')"
    return f"(len({p}) >= 3 AND length({p}[-1]) = 2 AND {p}[-2] IN ('ac','co','com','edu','gov','net','org'))"


def _label(x: str) -> str:
    return f"(string_split({x}, '.')[CASE WHEN {_two(x)} THEN -3 ELSE -2 END])"


def _text(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


@query("GEN07_profile_defaults", f"""WITH {_PROFILE}, f AS (SELECT *, CASE WHEN len(official) > 0 THEN {_label(_norm('official[1]'))} END AS first_label FROM pd)
SELECT brand_id, coalesce(nullif(trim(display), ''), nullif(trim(primary_name), '')) AS display_name, coalesce(nullif(trim(primary_name), ''), first_label, nullif(trim(display), '')) AS primary_name, array_to_string(official, ',') AS official,
  coalesce(first_label, {_text("coalesce(nullif(trim(primary_name), ''), nullif(trim(display), ''))")}) AS brand_label, CASE brand_id % 4 WHEN 0 THEN 'broad' WHEN 1 THEN 'standard' WHEN 3 THEN 'conservative' END AS noise_mode FROM f""")  # fmt: skip
def gen07(spark, d):
    p = P.profile_defaults(profile(spark, d).drop("primary"))
    return p.select("brand_id", "display_name", F.col("primary").alias("primary_name"), F.array_join("official", ",").alias("official"), "brand_label", "noise_mode")


def _official(spark, d) -> DataFrame:
    return P.profile_defaults(profile(spark, d).drop("primary")).select("brand_id", F.explode("official").alias("domain"))


@query("FLT12_tld_scope_enrich", f"""WITH {_PROFILE}, n AS (SELECT *, list_transform(official, lambda x: {_norm('x')}) AS o FROM pd)
SELECT brand_id, array_to_string(CASE WHEN len(list_filter(o, lambda x: ends_with(x, '.br'))) > 0 THEN list_concat(list_concat(scope, list_filter(['br','com.br','net.br','org.br'], lambda t: NOT list_contains(scope, t))), CASE WHEN len(list_filter(o, lambda x: ends_with(x, '.gov.br'))) > 0 THEN ['gov.br'] ELSE [] END)
  ELSE scope END, ',') AS scope FROM n""")  # fmt: skip
def flt12(spark, d):
    p = P.profile_defaults(profile(spark, d).drop("primary"))
    return p.select("brand_id", F.array_join(P.brazilian_scope(F.col("scope"), F.col("official")), ",").alias("scope"))


_ALIAS = f"""al AS (SELECT brand_id, primary_given AS value, 'brand_primary' AS type, 0 AS place FROM pr UNION ALL SELECT brand_id, unnest(aliases), 'brand_alias', unnest(range(100, 100 + len(aliases))) FROM pr
  UNION ALL SELECT brand_id, unnest(phrases), 'brand_phrase', unnest(range(200, 200 + len(phrases))) FROM pr UNION ALL SELECT brand_id, unnest(keywords), 'support_keyword', unnest(range(300, 300 + len(keywords))) FROM pr),
ai AS (SELECT brand_id, arg_min(trim(value), place) AS value, {_text('value')} AS normalized, type FROM al WHERE {_text('value')} <> '' GROUP BY brand_id, {_text('value')}, type)"""


@query("GEN06_alias_inputs", f"WITH {_PROFILE}, {_ALIAS} SELECT brand_id, value, normalized, type FROM ai")
def gen06(spark, d):
    return P.alias_inputs(profile(spark, d))


def _weight_sql(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in P.WEIGHTS.items()) + f" ELSE CAST({P.OTHER_WEIGHT} AS DOUBLE) END"


@query("GEN05_profile_seeds", f"""WITH {_PROFILE}, {_ALIAS}, od AS (SELECT brand_id, {_norm('x')} AS d FROM (SELECT brand_id, unnest(official) AS x FROM pd)),
sd AS (SELECT brand_id, {_text(_label('d'))} AS seed_value, 'domain_label' AS seed_type, 'registrable_domain' AS channel_scope FROM od UNION SELECT brand_id, d, 'official_domain', 'certificate_hostname' FROM od
  UNION SELECT brand_id, CASE WHEN {_two('d')} THEN {_label('d')} || '.' || string_split(d, '.')[-2] END, 'hostname_stem', 'certificate_hostname' FROM od
  UNION SELECT brand_id, normalized, type, CASE WHEN type = 'brand_primary' THEN 'both' ELSE 'associated_brand' END FROM ai)
SELECT *, {_weight_sql('seed_type')} AS base_weight FROM sd WHERE seed_value <> ''""")  # fmt: skip
def gen05(spark, d):
    return P.profile_seeds(_official(spark, d), P.alias_inputs(profile(spark, d)))


@query("JOB14_profile_sync", f"""WITH {_PROFILE}, nd AS (SELECT brand_id, {_norm('x')} AS domain FROM (SELECT brand_id, unnest(official) AS x FROM pd)), bd AS (SELECT brand_id, domain FROM nd WHERE brand_id % 7 <> 0 UNION SELECT brand_id, 'old' || brand_id || '.org' FROM nd WHERE brand_id % 11 = 0),
df AS (SELECT brand_id FROM (FROM nd EXCEPT FROM bd UNION ALL (FROM bd EXCEPT FROM nd))), cu AS (SELECT brand_id, unnest(scope) AS tld, 'delta' AS scan_phase, 20240100 + brand_id % 28 + 1 AS watermark_day FROM pr)
SELECT brand_id, tld, CASE WHEN brand_id IN (SELECT brand_id FROM df) THEN 'initial' ELSE scan_phase END AS scan_phase, CASE WHEN brand_id NOT IN (SELECT brand_id FROM df) THEN CAST(watermark_day AS INTEGER) END AS watermark_day FROM cu""")  # fmt: skip
def job14(spark, d):
    """An update adds domains to some brands and takes an old one from others."""
    after = _official(spark, d)
    old = after.filter("brand_id % 11 = 0").select("brand_id", F.concat(F.lit("old"), F.col("brand_id").cast("string"), F.lit(".org")).alias("domain"))
    before = after.filter("brand_id % 7 <> 0").unionByName(old)
    day = (F.lit(20240101) + F.col("brand_id") % 28).cast("int")
    cursors = profile(spark, d).select("brand_id", F.explode("scope").alias("tld"), F.lit("delta").alias("scan_phase"), day.alias("watermark_day"))
    return P.synced_cursors(cursors, before, after)


_QUOTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_COMBO = V.sql("SELECT 1", "company").removesuffix(" SELECT 1") + f""", b AS (SELECT brand_id, unnest([brand_label, substr(brand_label, 2)]) AS core, unnest([0, 1]) AS i, list_concat(list_concat({_QUOTED(S.RISK_WORDS)}, keywords), {_QUOTED(P.SUFFIXES)}) AS words FROM company),
w AS (SELECT brand_id, core, i, unnest(words) AS w, unnest(range(len(words))) AS j FROM b),
m AS (SELECT brand_id, {_text('core || w')} AS seed_value, 'combo_brand_keyword' AS seed_type, i * 1000 + 2 * j AS place FROM w UNION ALL SELECT brand_id, {_text('w || core')}, 'combo_keyword_brand', i * 1000 + 2 * j + 1 FROM w
  UNION ALL SELECT brand_id, {_text('p || core')}, 'combo_keyword_brand', 1000000 + i * 1000 + j FROM (SELECT *, unnest({_QUOTED(P.PREFIXES)}) AS p, unnest(range({len(P.PREFIXES)})) AS j FROM b)),
g AS (SELECT brand_id, seed_value, seed_type, min(place) AS place FROM m WHERE length(seed_value) >= 3 GROUP BY brand_id, seed_value, seed_type)
SELECT brand_id, seed_value, seed_type, {_weight_sql('seed_type')} AS base_weight FROM (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY place) AS r FROM g) WHERE r <= {P.MOST_COMBOS}"""


@query("GEN02_combo_seeds", _COMBO)
def gen02(spark, d):
    cores = V.company(spark, d).select("brand_id", F.array(F.col("brand_label"), F.substr("brand_label", F.lit(2))).alias("cores"), "keywords")
    return P.combo_seeds(cores).drop("place")


def _trusted(k):
    return F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("{}")).otherwise(F.concat(F.lit('{"cnpjs":["1","2"],"confirmed_domains":["a'), k.cast("string"), F.lit('.com"]}')))


@query("FN31_jsonb_append", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '1,2' END AS cnpjs, CASE WHEN c_custkey % 3 = 2 THEN 'a' || c_custkey || '.com,' ELSE '' END || 'cust' || c_custkey || '.com' AS confirmed FROM customer")
def fn31(spark, d):
    k = F.col("c_custkey")
    done = P.with_confirmed(_trusted(k), F.concat(F.lit("cust"), k.cast("string"), F.lit(".com")))
    x = F.from_json(done, "cnpjs array<string>, confirmed_domains array<string>")
    return V.table(spark, d, "customer").select("c_custkey", F.array_join(x["cnpjs"], ",").alias("cnpjs"), F.array_join(x["confirmed_domains"], ",").alias("confirmed"))


_REPLY_SQL = """CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || o || chr(10) || '```' WHEN 1 THEN 'I think: ' || o || ' - that is all' WHEN 2 THEN o WHEN 3 THEN 'no object here' WHEN 4 THEN '{"risco_score": ' || k WHEN 5 THEN '{"risco_score": 1, "categoria": "x"}' END"""
_OBJECT_SQL = """'{"risco_score": "' || k || '", "categoria": "c' || (k % 3) || '", "parecer_resumido": "p", "principais_motivos": ["m1", "m2"], "recomendacao_acao": "r {' || k || '}", "confianca": ' || (k + 1) || '}'"""


@query("FN36_llm_response_parse", "SELECT event_id, CASE WHEN event_id % 6 < 3 THEN CAST(k AS INTEGER) END AS score, CASE WHEN event_id % 6 < 3 THEN 'c' || (k % 3) END AS category, CASE WHEN event_id % 6 < 3 THEN 'r {' || k || '}' END AS action, CASE WHEN event_id % 6 < 3 THEN CAST(k + 1 AS INTEGER) END AS sure, CASE WHEN event_id % 6 < 3 THEN 'm1,m2' END AS why FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def fn36(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).withColumn("o", F.expr(_OBJECT_SQL))
    x = P.parsed_response(F.col("raw"))
    return e.withColumn("raw", F.expr(_REPLY_SQL)).select("event_id", x.alias("x")).select("event_id", F.col("x.risco_score").alias("score"), F.col("x.categoria").alias("category"), F.col("x.recomendacao_acao").alias("action"), F.col("x.confianca").alias("sure"), F.array_join("x.principais_motivos", ",").alias("why"))


_MODEL_SQL = """'{"seeds": [{"seed_value": "Shop-' || c_custkey || '", "seed_type": "llm_semantic"}, {"seed_value": "shop' || c_custkey || '", "seed_type": "llm_combo"}, {"seed_value": "x!", "seed_type": "llm_combo"}, {"seed_value": "pay ' || c_custkey || '", "seed_type": "odd"}, {"seed_value": "' || c_name || '", "seed_type": "llm_social_engineering"}]}'"""


@query("FN37_llm_seed_clean", "SELECT c_custkey AS brand_id, unnest(['shop' || c_custkey, 'pay' || c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g')]) AS seed_value, unnest(['llm_semantic', 'llm_combo', 'llm_social_engineering']) AS seed_type, unnest([CAST(0.58 AS DOUBLE), CAST(0.72 AS DOUBLE), CAST(0.68 AS DOUBLE)]) AS base_weight, unnest([1, 2, 3]) AS place FROM customer")
def fn37(spark, d):
    return P.model_seeds(V.table(spark, d, "customer").select(F.col("c_custkey").alias("brand_id"), F.expr(_MODEL_SQL).alias("reply")), 40)
