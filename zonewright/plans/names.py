"""Queries on names: label functions, candidate joins, scoring, seeds and the brand scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..operators import candidates as C
from ..operators import lake as O
from ..operators.postings import Postings
from ..operators.ranks import budget_rank
from ..operators.suffixes import registrable_parts
from ..sources import zones as Z
from . import views as V
from .register import SQL, query

# Neighbouring keys of each letter.
KEYS = {
    "a": "sqwz", "b": "vghn", "c": "xdfv", "d": "sfcxer", "e": "wrsdf", "f": "dgcvrt", "g": "fhbvty",
    "h": "gjbnyu", "i": "ujko", "j": "hknuim", "k": "jlmio", "l": "kop", "m": "njk", "n": "bhjm",
    "o": "iklp", "p": "ol", "q": "wa", "r": "edft", "s": "awedxz", "t": "rfgy", "u": "yhji",
    "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}


def as_of():
    return F.lit(V.AS_OF).cast("date")


_Q4 = "floor(({0}) * 10000.0 + 0.5) / 10000.0"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    x, y = _GRAMS.format(a), _GRAMS.format(b)
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / CAST(len({x}) + len({y}) - len(list_intersect({x}, {y})) AS DOUBLE) END"


_PLAIN = "translate(lower({0}), '0134578@$', 'oleastbas')"
_CLOSE = "(CASE WHEN greatest(length({0}), length({1})) = 0 THEN 0.0 ELSE 1.0 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE) END)"
_LIMIT = "CASE WHEN length({0}) <= 5 THEN 0.55 WHEN length({0}) <= 8 THEN 0.45 ELSE 0.35 END"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every plain name with every brand: five brands."""
    return C.without_subdomains(V.zone_today(spark, d)).crossJoin(C.few(V.brand(spark)))


_PAIRS = "p AS (SELECT z.*, b.* FROM zone_today z, brand b WHERE NOT contains(label, '.'))"


def _with_pairs(select: str) -> str:
    return V.sql("SELECT 1", "zone_today", "brand").removesuffix(" SELECT 1") + f", {_PAIRS} " + select


@query("FN01_trigram_similarity", _with_pairs(f"SELECT name, brand_id, {_sim('label', 'brand_label')} AS sim FROM p"))
def fn01(spark, d):
    """The set of a name is made once, not for each brand."""
    names = C.without_subdomains(V.zone_today(spark, d)).select("name", L.trigrams(F.col("label")).alias("x"))
    brands = V.brand(spark).select("brand_id", L.trigrams(F.col("brand_label")).alias("y"))
    return names.crossJoin(C.few(brands)).select("name", "brand_id", L.set_similarity(F.col("x"), F.col("y")).alias("sim"))


@query("FN02_levenshtein", _with_pairs("SELECT name, brand_id, CAST(levenshtein(label, brand_label) AS INTEGER) AS distance FROM p"))
def fn02(spark, d):
    return _pairs(spark, d).select("name", "brand_id", F.levenshtein("label", "brand_label").alias("distance"))


@query("FN03_normalized_lev", _with_pairs(f"SELECT name, brand_id, greatest({_CLOSE.format('label', 'brand_label')}, {_CLOSE.format(_PLAIN.format('label'), _PLAIN.format('brand_label'))}) AS closeness FROM p"))
def fn03(spark, d):
    return _pairs(spark, d).select("name", "brand_id", L.normalized_levenshtein(F.col("label"), F.col("brand_label")).alias("closeness"))


@query("FN06_homograph_normalize", V.sql(f"SELECT name, {_PLAIN.format('label')} AS plain FROM zone_today", "zone_today"))
def fn06(spark, d):
    return V.zone_today(spark, d).select("name", L.unmasked(F.col("label")).alias("plain"))


_BOUND = "(CASE WHEN contains({0}, {1}) THEN regexp_matches({0}, '(^|[^\\pL])' || {1}) OR regexp_matches({0}, {1} || '($|[^\\pL])') ELSE false END)"


@query("FN07_brand_boundary", _with_pairs(f"SELECT name, brand_id, {_BOUND.format('label', 'brand_label')} AS hit FROM p"))
def fn07(spark, d):
    return _pairs(spark, d).select("name", "brand_id", L.brand_boundary(F.col("label"), F.col("brand_label")).alias("hit"))


@query("FN08_residual_tokens", _with_pairs("SELECT name, brand_id, array_to_string(list_sort(list_distinct(regexp_extract_all(replace(label, brand_label, ' '), '[a-z0-9]+'))), ' ') AS rest FROM p WHERE contains(label, brand_label)"))
def fn08(spark, d):
    return _pairs(spark, d).filter(F.contains("label", "brand_label")).select("name", "brand_id", F.array_join(L.residual_tokens(F.col("label"), F.col("brand_label")), " ").alias("rest"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in S.RISK_WORDS) + "]"


def _hits(text: str, keys: str) -> str:
    return f"len(list_filter({keys}, lambda k: length(trim(lower(k))) > 0 AND (list_contains(regexp_extract_all({text}, '[a-z0-9]+'), trim(lower(k))) OR (length(trim(lower(k))) > 4 AND contains({text}, trim(lower(k)))))))"


_REST = f"replace({_PLAIN.format('label')}, {_PLAIN.format('brand_label')}, ' ')"


@query("FN09_keyword_hits", _with_pairs(f"SELECT name, brand_id, CAST({_hits(_REST, _WORDS)} AS INTEGER) AS risk_hits, CAST({_hits(_REST, 'keywords')} AS INTEGER) AS own_hits FROM p"))
def fn09(spark, d):
    plain, base = L.unmasked(F.col("label")), L.unmasked(F.col("brand_label"))
    words = F.array(*map(F.lit, S.RISK_WORDS))
    return _pairs(spark, d).select("name", "brand_id", L.keyword_hits(plain, base, words).alias("risk_hits"), L.keyword_hits(plain, base, F.col("keywords")).alias("own_hits"))


_SIGNALS = f"""s AS (SELECT *, {_sim('label', 'brand_label')} AS trigram, greatest({_CLOSE.format('label', 'brand_label')}, {_CLOSE.format(_PLAIN.format('label'), _PLAIN.format('brand_label'))}) AS edit,
  CASE WHEN {_BOUND.format(_PLAIN.format('label'), _PLAIN.format('brand_label'))} THEN 1.0 ELSE 0.0 END AS brand, least(1.0, {_hits(_REST, _WORDS)} * CAST(0.3 AS DOUBLE) + {_hits(_REST, 'keywords')} * CAST(0.2 AS DOUBLE)) AS keyword,
  {_CLOSE.format(_PLAIN.format('label'), _PLAIN.format('brand_label'))} AS homograph, label = brand_label AS exact FROM p),
c AS (SELECT *, trigram * CAST(0.30 AS DOUBLE) + edit * CAST(0.25 AS DOUBLE) + brand * CAST(0.20 AS DOUBLE) + keyword * CAST(0.15 AS DOUBLE) + homograph * CAST(0.10 AS DOUBLE) AS score FROM s),
r AS (SELECT *, CASE WHEN exact AND keyword = 0 THEN 'high' WHEN (NOT exact AND brand = 1 AND keyword >= 0.3 AND score >= 0.55) OR score >= 0.9 THEN 'critical' WHEN score >= 0.72 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS risk,
  list_filter([CASE WHEN exact THEN 'exact_label_match' END, CASE WHEN NOT exact AND edit >= 0.75 AND trigram >= 0.45 THEN 'typosquatting' END, CASE WHEN brand >= 1 AND NOT exact THEN 'brand_containment' END,
    CASE WHEN keyword > 0 THEN 'risky_keywords' END, CASE WHEN NOT exact AND homograph >= 0.95 AND homograph > trigram THEN 'homograph_attack' END], lambda x: x IS NOT NULL) AS found FROM c),
f AS (SELECT *, CASE WHEN len(found) = 0 THEN ['lexical_similarity'] ELSE found END AS why FROM r)"""


def _with_signals(select: str) -> str:
    return _with_pairs("SELECT 1").removesuffix(" SELECT 1") + f", {_SIGNALS} " + select


_CHANNELS = ("registrable_domain", "certificate_hostname", "associated_brand", "both", "other")


def _channel(name: Column) -> Column:
    return V._pick(_CHANNELS, L.stable_shard(name, 5))


def _signals(spark: SparkSession, d: str) -> tuple[DataFrame, S.Signals]:
    """What a name or a brand has of its own is made once, not for each pair: the number of trigrams and their text, the label without look-alikes, its risk words."""
    names = C.without_subdomains(V.zone_today(spark, d)).withColumn("plain", L.unmasked(F.col("label"))).withColumn("padded", L.padded(F.col("label")))
    names = names.select("name", "label", "plain", "padded", L.padded_count(F.col("padded")).alias("n"), S.risk_words(F.col("plain")).alias("risky"), _channel(F.col("name")).alias("channel"))
    brands = V.brand(spark).select("brand_id", "brand_label", "keywords", L.tidy_keywords(F.col("keywords")).alias("keys"), L.unmasked(F.col("brand_label")).alias("base"), L.trigrams(F.col("brand_label")).alias("gy"))
    # What the scores use more than once is a column of its own.
    p = names.crossJoin(C.few(brands)).withColumn("both", L.padded_shared(F.col("padded"), F.col("gy"))).withColumn("close", L.closeness(F.col("plain"), F.col("base")))
    trigram = L.counted_similarity(F.col("both"), F.col("n"), F.size("gy"))
    s = S.signals(F.col("label"), F.col("brand_label"), F.col("keywords"), trigram, F.col("plain"), F.col("base"), F.col("risky"), F.col("keys"), F.col("close"))
    p = p.select("name", "brand_id", "channel", s.trigram.alias("t"), s.edit.alias("e"), s.brand.alias("b"), s.keyword.alias("k"), s.homograph.alias("h"), s.exact.alias("x"))
    return p, S.Signals(*[F.col(c) for c in "tebkhx"])


@query("FN10_keyword_score", _with_signals("SELECT name, brand_id, keyword AS score FROM s"))
def fn10(spark, d):
    p, s = _signals(spark, d)
    return p.select("name", "brand_id", s.keyword.alias("score"))


@query("FN11_composite_score", _with_signals(f"SELECT name, brand_id, {_Q4.format('score')} AS score FROM c"))
def fn11(spark, d):
    p, s = _signals(spark, d)
    return p.select("name", "brand_id", L.round4(S.composite(s)).alias("score"))


@query("FN12_risk_level", _with_signals("SELECT name, brand_id, risk FROM r"))
def fn12(spark, d):
    p, s = _signals(spark, d)
    return p.select("name", "brand_id", S.risk_level(s, S.composite(s)).alias("risk"))


@query("FN13_reasons", _with_signals("SELECT name, brand_id, array_to_string(why, ',') AS reasons FROM f"))
def fn13(spark, d):
    p, s = _signals(spark, d)
    return p.select("name", "brand_id", F.array_join(S.reasons(s), ",").alias("reasons"))


_SEEDED = f"""g AS (SELECT *, (['registrable_domain','certificate_hostname','associated_brand','both','other'])[{V._SHARD.format('name', 5)} + 1] AS channel FROM f),
h AS (SELECT *, {_Q4.format("least(1.0, (" + _Q4.format('score') + ") * CAST(0.70 AS DOUBLE) + CAST(0.9 AS DOUBLE) * CAST(0.20 AS DOUBLE) + CASE channel WHEN 'registrable_domain' THEN CAST(1.00 AS DOUBLE) WHEN 'certificate_hostname' THEN CAST(0.85 AS DOUBLE) WHEN 'both' THEN CAST(0.90 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END * CAST(0.10 AS DOUBLE))")} AS seeded,
  CASE WHEN channel = 'certificate_hostname' THEN CAST(0.02 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS more FROM g)"""


@query(
    "FN14_seeded_score",
    _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SEEDED} SELECT name, brand_id, seeded FROM h",
)
def fn14(spark, d):
    return _seeded(spark, d).select("name", "brand_id", "seeded")


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    p, s = _signals(spark, d)
    p = p.withColumn("why", S.reasons(s))
    return p.withColumn("seeded", L.round4(S.seeded_score(L.round4(S.composite(s)), F.lit(0.9), F.col("channel"))))


@query(
    "FN15_seeded_risk",
    _with_signals("SELECT 1").removesuffix(" SELECT 1") + f""", {_SEEDED} SELECT name, brand_id, CASE WHEN list_contains(why, 'exact_label_match') AND seeded >= 0.78 THEN 'high'
  WHEN list_contains(why, 'homograph_attack') AND list_contains(why, 'risky_keywords') AND seeded >= more + CAST(0.60 AS DOUBLE) THEN 'critical' WHEN list_contains(why, 'homograph_attack') AND seeded >= more + CAST(0.58 AS DOUBLE) THEN 'high'
  WHEN list_contains(why, 'brand_containment') AND list_contains(why, 'risky_keywords') AND seeded >= more + CAST(0.64 AS DOUBLE) THEN 'critical' WHEN seeded >= more + CAST(0.78 AS DOUBLE) THEN 'high'
  WHEN seeded >= more + CAST(0.55 AS DOUBLE) THEN 'medium' ELSE 'low' END AS risk FROM h""",
)
def fn15(spark, d):
    """From the conditions: no list of reasons is made for a pair."""
    s = S.Signals(*[F.col(c) for c in "tebkhx"])
    return _seeded(spark, d).select("name", "brand_id", S.seeded_risk(F.col("seeded"), S.conditions(s), F.col("channel")).alias("risk"))


_RULE = """CASE WHEN list_contains(why, 'exact_label_match') THEN 'exact_label_match' WHEN list_contains(why, 'homograph_attack') THEN 'homograph' WHEN list_contains(why, 'typosquatting') THEN 'typo_candidate'
  WHEN list_contains(why, 'brand_containment') AND list_contains(why, 'risky_keywords') THEN 'brand_plus_keyword' WHEN list_contains(why, 'brand_containment') THEN CASE WHEN {0} = 'certificate_hostname' THEN 'hostname_containment' ELSE 'brand_containment' END
  ELSE 'lexical_similarity' END"""


@query("FN16_matched_rule", _with_signals("SELECT 1").removesuffix(" SELECT 1") + f", {_SEEDED} SELECT name, brand_id, {_RULE.format('channel')} AS rule FROM h")
def fn16(spark, d):
    return _seeded(spark, d).select("name", "brand_id", S.matched_rule(F.col("why"), F.col("channel")).alias("rule"))


@query("FN22_stable_shard", V.sql(f"SELECT name, CAST({V._SHARD.format('name', 128)} AS INTEGER) AS shard FROM zone_today", "zone_today"))
def fn22(spark, d):
    return V.zone_today(spark, d).select("name", L.stable_shard(F.col("name"), 128).alias("shard"))


@query("FN23_date_int", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS day, CAST(o_orderdate AS DATE) AS back FROM orders")
def fn23(spark, d):
    day = L.date_int(F.col("o_orderdate"))
    return V.table(spark, d, "orders").select("o_orderkey", day.alias("day"), L.int_date(day).alias("back"))


@query("FN24_age_days", V.sql(f"SELECT name, CAST(greatest(date_diff('day', CAST(strptime(CAST(added_day AS VARCHAR), '%Y%m%d') AS DATE), DATE '{V.AS_OF}'), 0) AS INTEGER) AS age FROM zone_today", "zone_today"))
def fn24(spark, d):
    return V.zone_today(spark, d).select("name", L.age_days(F.col("added_day"), as_of()).alias("age"))


@query("FN32_url_parts", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def fn32(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path"))


@query("FN33_base64_raw", V.sql("SELECT name, to_base64(encode(name)) AS raw FROM zone_today", "zone_today"))
def fn33(spark, d):
    return V.zone_today(spark, d).select("name", F.base64(F.encode("name", "ISO-8859-1")).alias("raw"))


@query("PRJ01_extract_label", V.sql("SELECT page_id, CASE WHEN ends_with(host, '.example.com') THEN left(host, length(host) - 12) ELSE regexp_replace(host, '\\.[^.]*$', '') END AS label FROM host", "host"))
def prj01(spark, d):
    return V.host(spark, d).select("page_id", L.extract_label(F.col("host"), F.lit("example.com")).alias("label"))


@query("PRJ02_label_backfill", V.sql("SELECT name, left(name, length(name) - length(tld) - 1) AS label FROM zone_today", "zone_today"))
def prj02(spark, d):
    return V.zone_today(spark, d).select("name", L.left_of_tld(F.col("name"), F.col("tld")).alias("label"))


_NORMAL = "CASE WHEN length(x) <= 253 AND regexp_full_match(x, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+') THEN x END"


@query("PRJ03_normalize_domain", V.sql(f"SELECT page_id, {_NORMAL} AS domain FROM (SELECT page_id, trim(lower(trim(' ' || upper(host) || '. ')), '.') AS x FROM host)", "host"))
def prj03(spark, d):
    raw = F.concat(F.lit(" "), F.upper("host"), F.lit(". "))
    return V.host(spark, d).select("page_id", L.normalize_domain(raw).alias("domain"))


_PARTS = "q AS (SELECT name, string_split(name, '.') AS p FROM zone_today), t AS (SELECT name, p, len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ('ac','co','com','edu','gov','net','org') AS two FROM q)"


def _with_parts(select: str) -> str:
    return V.sql("SELECT 1", "zone_today").removesuffix(" SELECT 1") + f", {_PARTS} " + select


@query("PRJ04_registrable_parts", _with_parts("SELECT name, array_to_string(p[CASE WHEN two THEN -3 ELSE -2 END:], '.') AS domain, p[CASE WHEN two THEN -3 ELSE -2 END] AS label, array_to_string(p[CASE WHEN two THEN -2 ELSE -1 END:], '.') AS suffix FROM t"))
def prj04(spark, d):
    n = F.col("name")
    return V.zone_today(spark, d).select("name", L.registrable_domain(n).alias("domain"), L.registrable_label(n).alias("label"), L.public_suffix(n).alias("suffix"))


# Rules that match hosts of the pages, and hosts under rules of every kind.
_RULES = ("com", "net", "org", "// a comment", "example.net", "*.example.com", "!ththon.example.com", "!www.ck", "*.ck", "com.br", "br", "*.kawasaki.jp", "!city.kawasaki.jp", "jp")
_RULED_HOSTS = ("www.ck", "a.www.ck", "foo.ck", "a.foo.ck", "b.a.foo.ck", "shop.com.br", "com.br", "x.y.kawasaki.jp", "city.kawasaki.jp", "a.city.kawasaki.jp", "co.uk", "a.co.uk", "x.unknown", "single")
_HOSTS_SQL = "h AS (SELECT DISTINCT host FROM host WHERE host <> '' UNION SELECT unnest([" + ", ".join(f"'{h}'" for h in _RULED_HOSTS) + "]))"
_RULES_SQL = "r AS (SELECT ltrim(ltrim(x, '!'), '*.') AS suffix, starts_with(x, '!') AS exc, starts_with(x, '*.') AS wild FROM (SELECT unnest([" + ", ".join(f"'{r}'" for r in _RULES if not r.startswith("//")) + "]) AS x))"


@query(
    "PRJ04_registrable_parts_rules",
    V.sql("SELECT 1", "host").removesuffix(" SELECT 1")
    + f""", {_HOSTS_SQL}, {_RULES_SQL}, p AS (SELECT host, string_split(host, '.') AS p, len(string_split(host, '.')) AS n FROM h),
s AS (SELECT host, p, n, unnest(range(1, n + 1)) AS k FROM p),
m AS (SELECT s.host, max(CASE WHEN exc THEN 1000 + k - 1 WHEN wild THEN k + 1 ELSE k END) AS k FROM s JOIN r ON array_to_string(p[n - k + 1 :], '.') = suffix AND (NOT wild OR n > k) GROUP BY s.host),
f AS (SELECT p.host, p, n, CASE WHEN n > m.k % 1000 THEN m.k % 1000 END AS k, CASE WHEN n >= 3 AND length(p[n]) = 2 AND p[n - 1] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 WHEN n >= 2 THEN 1 END AS other FROM p LEFT JOIN m ON p.host = m.host)
SELECT host, array_to_string(p[n - coalesce(k, other) :], '.') AS registrable_domain, p[n - coalesce(k, other)] AS registrable_label, array_to_string(p[n - coalesce(k, other) + 1 :], '.') AS public_suffix FROM f""",
)
def prj04_rules(spark, d):
    """Registrable domains by suffix rules with wildcards and exceptions."""
    more = spark.createDataFrame([(h,) for h in _RULED_HOSTS], "host string")
    hosts = V.host(spark, d).select("host").filter("host <> ''").unionByName(more).distinct()
    return registrable_parts(hosts, spark.createDataFrame([(r,) for r in _RULES], "rule string"), "host").select("host", "registrable_domain", "registrable_label", "public_suffix")


@query("PRJ05_looks_like_domain", _with_parts("SELECT name, name = array_to_string(p[CASE WHEN two THEN -3 ELSE -2 END:], '.') AS is_domain FROM t"))
def prj05(spark, d):
    return V.zone_today(spark, d).select("name", (F.col("name") == L.registrable_domain(F.col("name"))).alias("is_domain"))


@query("PRJ06_hostname_stem", _with_parts("SELECT name, CASE WHEN two THEN p[-3] || '.' || p[-2] END AS stem FROM t"))
def prj06(spark, d):
    return V.zone_today(spark, d).select("name", L.hostname_stem(F.col("name")).alias("stem"))


@query("PRJ07_brand_text_normalize", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS brand FROM customer")
def prj07(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", L.brand_text(F.col("c_name")).alias("brand"))


@query("PRJ08_registrant_id_normalize", "SELECT o_orderkey, regexp_replace(strftime(o_orderdate, '%Y-%m-%d') || ' / ' || o_orderkey, '[.\\-/\\s]', '', 'g') AS registrant FROM orders")
def prj08(spark, d):
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" / "), F.col("o_orderkey").cast("string"))
    return V.table(spark, d, "orders").select("o_orderkey", L.registrant_id(raw).alias("registrant"))


@query("FLT01_watermark_filter", V.sql("SELECT * FROM zone_today WHERE added_day >= 20240120", "zone_today"))
def flt01(spark, d):
    return V.zone_today(spark, d).filter(F.col("added_day") >= 20240120)


@query("FLT02_no_subdomains", V.sql("SELECT page_id, host FROM host WHERE NOT contains(regexp_replace(host, '\\.example\\.(com|net|org)$', ''), '.')", "host"))
def flt02(spark, d):
    hosts = V.host(spark, d).withColumn("label", F.regexp_replace("host", r"\.example\.(com|net|org)$", ""))
    return C.without_subdomains(hosts).select("page_id", "host")


@query("FLT03_tld_partition_filter", V.sql("SELECT * FROM zone_today WHERE tld IN ('com', 'com.br')", "zone_today"))
def flt03(spark, d):
    return V.zone_today(spark, d).filter(F.col("tld").isin("com", "com.br"))


@query("FLT04_punycode_filter", V.sql("SELECT * FROM zone_xn WHERE starts_with(label, 'xn--')", "zone_xn"))
def flt04(spark, d):
    return C.encoded_names(V.zone_xn(spark, d))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return _seeds_of(V.brand(spark))


def _seeds_of(b: DataFrame) -> DataFrame:
    """Two seeds for each brand: its label, and its label without the first letter as an alias."""
    own = b.select(F.col("brand_label").alias("seed_value"), F.lit("domain_label").alias("seed_type"), F.lit("registrable_domain").alias("channel_scope"), F.lit(1.0).alias("base_weight"), *b.columns)
    alias = b.select(F.substr("brand_label", F.lit(2)).alias("seed_value"), F.lit("brand_alias").alias("seed_type"), F.lit("associated_brand").alias("channel_scope"), F.lit(0.65).alias("base_weight"), *b.columns)
    return own.unionByName(alias)


_SEEDS = """seed AS (SELECT brand_label AS seed_value, 'domain_label' AS seed_type, 'registrable_domain' AS channel_scope, CAST(1.0 AS DOUBLE) AS base_weight, * FROM brand
  UNION ALL SELECT substr(brand_label, 2), 'brand_alias', 'associated_brand', CAST(0.65 AS DOUBLE), * FROM brand)"""


def _with_seeds(select: str) -> str:
    return V.sql("SELECT 1", "zone_today", "brand").removesuffix(" SELECT 1") + f", {_SEEDS}, n AS (SELECT * FROM zone_today WHERE NOT contains(label, '.')) " + select


def _of_companies(sql: str) -> str:
    """The seeds' SQL over the companies instead of the five brands."""
    return sql.replace(f"brand AS {V.SQL['brand']}", f"brand AS {V.SQL['company']}")


@query("FLT07_seed_filter", _of_companies(_with_seeds("SELECT brand_id, seed_value, seed_type FROM seed WHERE length(seed_value) >= 3 AND channel_scope IN ('registrable_domain', 'associated_brand', 'both') AND seed_type IN ('domain_label', 'brand_primary', 'brand_alias', 'brand_phrase')")))
def flt07(spark, d):
    s = _seeds_of(V.company(spark, d))
    return s.filter((F.length("seed_value") >= 3) & F.col("channel_scope").isin("registrable_domain", "associated_brand", "both") & F.col("seed_type").isin("domain_label", "brand_primary", "brand_alias", "brand_phrase")).select("brand_id", "seed_value", "seed_type")


@query("JON04_exact_label_semi", _with_seeds("SELECT n.name, s.seed_value FROM n JOIN (SELECT DISTINCT seed_value FROM seed) s ON n.label = s.seed_value"))
def jon04(spark, d):
    return C.exact_candidates(V.zone_today(spark, d), _seeds(spark, d).select("seed_value").distinct()).select("name", "seed_value")


_NEAR = f"SELECT n.name, n.tld, n.label, n.added_day, s.seed_value, {_sim('n.label', 's.seed_value')} AS sim FROM n, (SELECT DISTINCT seed_value FROM seed) s"


@query("JON05_trigram_similarity_join", _with_seeds(f"SELECT name, seed_value, sim FROM ({_NEAR}) WHERE sim >= {_LIMIT.format('seed_value')}"))
def jon05(spark, d):
    names = C.without_subdomains(V.zone_today(spark, d))
    return C.trigram_candidates(names, _seeds(spark, d).select("seed_value").distinct()).select("name", "seed_value", "sim")


@query("JON05_trigram_postings", SQL["JON05_trigram_similarity_join"])
def jon05_postings(spark, d):
    """The same from posting lists of yesterday's names, to which today's delta is added and those gone are noted."""
    # Each snapshot is read three times: once is enough to cut it from the texts.
    today, yesterday = (Z.stored(C.without_subdomains(z(spark, d)), "snapshot") for z in (V.zone_today, V.zone_yesterday))
    index = Postings.create(yesterday, Z.scratch(spark, "postings"))
    index.add(yesterday, 1)
    index.add(O.added(today, yesterday), 2)
    index.remove(O.removed(today, yesterday), 2)
    return index.candidates(_seeds(spark, d).select("seed_value")).select("name", "seed_value", "sim")


@query("JON06_substring_join", _with_seeds("SELECT n.name, s.seed_value FROM n JOIN (SELECT DISTINCT seed_value FROM seed) s ON contains(n.label, s.seed_value)"))
def jon06(spark, d):
    names = C.without_subdomains(V.zone_today(spark, d))
    return C.substring_candidates(names, _seeds(spark, d).select("seed_value").distinct()).select("name", "seed_value")


_UNION = f"u AS (SELECT DISTINCT name, tld, label, added_day, seed_value, sim FROM ({_NEAR}) WHERE sim >= {_LIMIT.format('seed_value')} OR contains(label, seed_value))"


@query("SET02_candidate_union", _with_seeds("SELECT 1").removesuffix(" SELECT 1") + f", {_UNION} SELECT name, seed_value, sim FROM u")
def set02(spark, d):
    names, seeds = C.without_subdomains(V.zone_today(spark, d)), _seeds(spark, d).select("seed_value").distinct()
    return C.trigram_candidates(names, seeds).unionByName(C.substring_candidates(names, seeds)).select("name", "seed_value", "sim").distinct()


@query("WIN05_best_by_name", _with_seeds("SELECT 1").removesuffix(" SELECT 1") + f", {_UNION} SELECT name, max(sim) AS sim FROM u GROUP BY name")
def win05(spark, d):
    names, seeds = C.without_subdomains(V.zone_today(spark, d)), _seeds(spark, d).select("seed_value").distinct()
    both = C.trigram_candidates(names, seeds).unionByName(C.substring_candidates(names, seeds))
    return both.groupBy("name").agg(F.max("sim").alias("sim"))


@query("SRT05_per_seed_limit", _with_seeds("SELECT 1").removesuffix(" SELECT 1") + f", {_UNION}, lim AS (SELECT greatest(250, least(1500, 5000 // count(DISTINCT seed_value))) AS most FROM seed) SELECT name, seed_value, sim FROM (SELECT *, row_number() OVER (PARTITION BY seed_value, tld ORDER BY sim DESC, name) AS r FROM u) WHERE r <= (SELECT most FROM lim)")
def srt05(spark, d):
    names, seeds = C.without_subdomains(V.zone_today(spark, d)), _seeds(spark, d).select("seed_value").distinct()
    both = C.best_by_name(C.trigram_candidates(names, seeds).unionByName(C.substring_candidates(names, seeds)))
    return C.per_seed_limit(both, C.seed_limit(seeds.count())).select("name", "seed_value", "sim")


_ENCODED_LIMIT_SQL = "CASE n.tld WHEN 'com' THEN 2000 WHEN 'net' THEN 1500 WHEN 'org' THEN 1500 ELSE 1200 END"


@query("SRT03_punycode_topk", V.sql("SELECT 1", "zone_xn", "brand").removesuffix(" SELECT 1") + f", n AS (SELECT * FROM zone_xn) SELECT name, brand_id, CAST(distance AS INTEGER) AS distance FROM (SELECT n.name, n.tld, b.brand_id, levenshtein(n.label, b.brand_label) AS distance, {_ENCODED_LIMIT_SQL} AS most, row_number() OVER (PARTITION BY b.brand_id, n.tld ORDER BY levenshtein(n.label, b.brand_label), n.added_day DESC, n.name) AS r FROM n, brand b WHERE starts_with(n.label, 'xn--')) WHERE r <= most")
def srt03(spark, d):
    return C.encoded_candidates(V.zone_xn(spark, d), V.brand(spark)).select("name", "brand_id", "distance")


@query("SRT02_search_page", _with_seeds(f"SELECT name, sim FROM (SELECT name, added_day, {_sim('label', chr(39) + 'thatin' + chr(39))} AS sim FROM n) WHERE sim >= 0.3 ORDER BY sim DESC, added_day DESC, name LIMIT 50 OFFSET 10"))
def srt02(spark, d):
    found = search(V.zone_today(spark, d), "thatin")
    return found.orderBy(F.desc("sim"), F.desc("added_day"), "name").offset(10).limit(50).select("name", "sim")


def search(names: DataFrame, text: str) -> DataFrame:
    """Names similar to one query label: 0.5 for short queries, 0.3 for longer ones.

    The query is a seed of its own: only names that share a trigram with it, and could reach the bound, are counted.
    """
    seed = names.sparkSession.createDataFrame([(text,)], "seed_value string")
    return C.trigram_candidates(C.without_subdomains(names), seed, F.lit(0.5 if len(text) <= 5 else 0.3))


@query("SRT04_punycode_recent", V.sql("SELECT name, added_day FROM zone_xn WHERE starts_with(label, 'xn--') ORDER BY added_day DESC NULLS LAST, name LIMIT 100", "zone_xn"))
def srt04(spark, d):
    return C.encoded_names(V.zone_xn(spark, d)).orderBy(F.desc_nulls_last("added_day"), "name").limit(100).select("name", "added_day")


_KEYS_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in KEYS.items()) + ") k(c, near)"
_TYPO = f"""a AS (SELECT brand_label AS x, unnest(range(1, length(brand_label) + 1)) AS i FROM brand),
b AS (SELECT x, i, substr(x, 1, i - 1) AS head, substr(x, i + 1) AS tail, substr(x, i, 1) AS c FROM a),
v AS (SELECT x, head || tail AS variant, 'omission' AS kind FROM b UNION SELECT x, head || c || c || tail, 'duplication' FROM b
  UNION SELECT x, head || substr(x, i + 1, 1) || c || substr(x, i + 2), 'swap' FROM b WHERE i < length(x)
  UNION SELECT x, head || unnest(string_split(near, '')) || tail, 'key' FROM b JOIN {_KEYS_SQL} ON k.c = b.c
  UNION SELECT x, head || look || tail, 'look' FROM b JOIN (VALUES ('0','o'),('1','l'),('3','e'),('4','a'),('5','s'),('7','t'),('8','b'),('@','a'),('$','s')) l(look, letter) ON letter = b.c)"""


@query("GEN01_typo_candidates", _of_companies(V.sql("SELECT 1", "brand").removesuffix(" SELECT 1") + f", {_TYPO} SELECT x AS brand_label, variant, kind FROM v WHERE variant <> x AND variant <> ''"))
def gen01(spark, d):
    return C.typo_variants(V.company(spark, d), "brand_label", KEYS)


@query("GEN03_typo_seeds", _of_companies(V.sql("SELECT 1", "brand").removesuffix(" SELECT 1") + f", {_TYPO} SELECT brand_label, variant FROM (SELECT x AS brand_label, variant, row_number() OVER (PARTITION BY x ORDER BY length(variant), variant) AS r FROM (SELECT DISTINCT x, variant FROM v WHERE variant <> x AND variant <> '')) WHERE r <= 50"))
def gen03(spark, d):
    from pyspark.sql import Window

    v = C.typo_variants(V.company(spark, d), "brand_label", KEYS).select("brand_label", "variant").distinct()
    w = Window.partitionBy("brand_label").orderBy(F.length("variant"), "variant")
    return v.withColumn("r", F.row_number().over(w)).filter("r <= 50").drop("r")


@query("JON20_keyword_unnest", V.sql("SELECT brand_id, unnest(keywords) AS keyword FROM company", "company"))
def jon20(spark, d):
    return V.company(spark, d).select("brand_id", F.explode("keywords").alias("keyword"))


@query("GEN08_seed_families", _of_companies(_with_seeds("SELECT brand_id, seed_type, count(*) AS n, string_agg(seed_value, ',' ORDER BY seed_value) AS seeds FROM seed GROUP BY brand_id, seed_type")))
def gen08(spark, d):
    return _seeds_of(V.company(spark, d)).groupBy("brand_id", "seed_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("seed_value")), ",").alias("seeds"))


@query("JON19_brand_tld_cross", V.sql("SELECT brand_id, tld FROM brand, (SELECT DISTINCT tld FROM zone_today)", "zone_today", "brand"))
def jon19(spark, d):
    return V.zone_today(spark, d).select("tld").distinct().crossJoin(C.few(V.brand(spark).select("brand_id")))


@query("FLT11_effective_tlds", V.sql("SELECT brand_id, t.tld FROM brand b, (SELECT DISTINCT tld FROM zone_today) t WHERE brand_id % 2 = 0 OR t.tld = 'com'", "zone_today", "brand"))
def flt11(spark, d):
    """An empty scope stands for all endings."""
    scope = F.when(F.col("brand_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("com")))
    b, t = V.brand(spark).select("brand_id", scope.alias("scope")), V.zone_today(spark, d).select("tld").distinct()
    return t.join(C.few(b), (F.size("scope") == 0) | F.array_contains("scope", F.col("tld"))).select("brand_id", "tld")


_SCAN = f"""m0 AS (SELECT u.name, u.tld, u.label, u.added_day, u.seed_value, u.sim AS trigram, s.seed_type, s.channel_scope, s.base_weight, s.brand_id, s.brand_label AS owner, s.keywords, s.noise_mode, s.seed_value AS brand_label FROM u JOIN seed s ON u.seed_value = s.seed_value),
m1 AS (SELECT *, greatest({_CLOSE.format('label', 'brand_label')}, {_CLOSE.format(_PLAIN.format('label'), _PLAIN.format('brand_label'))}) AS edit, CASE WHEN {_BOUND.format(_PLAIN.format('label'), _PLAIN.format('brand_label'))} THEN 1.0 ELSE 0.0 END AS brand,
  least(1.0, {_hits(_REST, _WORDS)} * CAST(0.3 AS DOUBLE) + {_hits(_REST, 'keywords')} * CAST(0.2 AS DOUBLE)) AS keyword, {_CLOSE.format(_PLAIN.format('label'), _PLAIN.format('brand_label'))} AS homograph, label = brand_label AS exact FROM m0),
m2 AS (SELECT *, {_Q4.format('trigram * CAST(0.30 AS DOUBLE) + edit * CAST(0.25 AS DOUBLE) + brand * CAST(0.20 AS DOUBLE) + keyword * CAST(0.15 AS DOUBLE) + homograph * CAST(0.10 AS DOUBLE)')} AS base,
  list_filter([CASE WHEN exact THEN 'exact_label_match' END, CASE WHEN NOT exact AND edit >= 0.75 AND trigram >= 0.45 THEN 'typosquatting' END, CASE WHEN brand >= 1 AND NOT exact THEN 'brand_containment' END,
    CASE WHEN keyword > 0 THEN 'risky_keywords' END, CASE WHEN NOT exact AND homograph >= 0.95 AND homograph > trigram THEN 'homograph_attack' END], lambda x: x IS NOT NULL) AS found FROM m1),
m3 AS (SELECT *, CASE WHEN len(found) = 0 THEN ['lexical_similarity'] ELSE found END AS why, {_Q4.format("least(1.0, base * CAST(0.70 AS DOUBLE) + base_weight * CAST(0.20 AS DOUBLE) + CASE channel_scope WHEN 'registrable_domain' THEN CAST(1.00 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END * CAST(0.10 AS DOUBLE))")} AS score_final,
  CASE WHEN seed_type = 'domain_label' THEN 'registrable_domain' ELSE 'associated_brand' END AS matched_channel FROM m2),
m4 AS (SELECT *, {_RULE.format('matched_channel')} AS matched_rule, CASE WHEN list_contains(why, 'exact_label_match') AND score_final >= 0.78 THEN 'high' WHEN list_contains(why, 'homograph_attack') AND list_contains(why, 'risky_keywords') AND score_final >= 0.60 THEN 'critical'
  WHEN list_contains(why, 'homograph_attack') AND score_final >= 0.58 THEN 'high' WHEN list_contains(why, 'brand_containment') AND list_contains(why, 'risky_keywords') AND score_final >= 0.64 THEN 'critical' WHEN score_final >= 0.78 THEN 'high' WHEN score_final >= 0.55 THEN 'medium' ELSE 'low' END AS risk_level,
  date_diff('day', CAST(strptime(CAST(added_day AS VARCHAR), '%Y%m%d') AS DATE), DATE '{V.AS_OF}') AS age, seed_type = 'brand_alias' AND length(seed_value) <= 5 AND seed_value <> owner AS generic FROM m3),
m5 AS (SELECT *, greatest(0.0, least(1.0, score_final * CAST(0.35 AS DOUBLE) + CASE WHEN age <= 30 THEN CAST(0.18 AS DOUBLE) ELSE CAST(0.08 AS DOUBLE) END
  + CASE WHEN matched_rule <> 'exact_label_match' THEN 0 WHEN seed_type = 'domain_label' THEN CAST(0.32 AS DOUBLE) WHEN generic THEN CAST(-0.12 AS DOUBLE) ELSE CAST(0.16 AS DOUBLE) END
  + CASE matched_rule WHEN 'typo_candidate' THEN CAST(0.38 AS DOUBLE) WHEN 'homograph' THEN CAST(0.42 AS DOUBLE) WHEN 'brand_plus_keyword' THEN CAST(0.34 AS DOUBLE) WHEN 'brand_containment' THEN CASE WHEN matched_channel = 'associated_brand' THEN CAST(0.04 AS DOUBLE) ELSE CAST(0.10 AS DOUBLE) END ELSE 0 END
  + CAST(0.05 AS DOUBLE) + CASE WHEN risk_level IN ('high', 'critical') THEN CAST(0.10 AS DOUBLE) ELSE 0 END + CASE WHEN generic THEN CAST(-0.10 AS DOUBLE) ELSE 0 END + CASE WHEN starts_with(label, 'login') OR ends_with(label, 'login') THEN CAST(0.10 AS DOUBLE) ELSE 0 END)) AS act FROM m4),
m6 AS (SELECT *, CASE WHEN matched_rule IN ('typo_candidate', 'homograph', 'brand_plus_keyword') AND act >= 0.68 THEN 'immediate_attention' WHEN matched_rule = 'exact_label_match' AND seed_type = 'domain_label' THEN 'defensive_gap'
  WHEN act >= 0.72 AND risk_level IN ('high', 'critical') THEN 'immediate_attention' WHEN act >= 0.48 THEN 'defensive_gap' ELSE 'watchlist' END AS attention_bucket FROM m5),
m7 AS (SELECT *, row_number() OVER (PARTITION BY brand_id, name ORDER BY score_final DESC, base_weight DESC, seed_type, seed_value) AS r FROM m6
  WHERE score_final >= CASE noise_mode WHEN 'conservative' THEN 0.60 WHEN 'standard' THEN 0.50 WHEN 'broad' THEN 0.42 ELSE 0.40 END),
best AS (SELECT * FROM m7 WHERE r = 1)"""


def with_scan(select: str) -> str:
    return _with_seeds("SELECT 1").removesuffix(" SELECT 1") + f", {_UNION}, {_SCAN} " + select


def scan(spark: SparkSession, d: str) -> DataFrame:
    return C.brand_scan(V.zone_today(spark, d), _seeds(spark, d), as_of())


@query("JOB05_brand_scan", with_scan(f"SELECT brand_id, name, seed_value, score_final, risk_level, matched_rule, array_to_string(why, ',') AS reasons, {_Q4.format('act')} AS actionability_score, attention_bucket FROM best"))
def job05(spark, d):
    return scan(spark, d).select("brand_id", "name", "seed_value", "score_final", "risk_level", "matched_rule", F.array_join("reasons", ",").alias("reasons"), "actionability_score", "attention_bucket")


_SCAN_COLUMNS = f"SELECT brand_id, name, seed_value, score_final, risk_level, matched_rule, array_to_string(why, ',') AS reasons, {_Q4.format('act')} AS actionability_score, attention_bucket FROM best"
_TYPO_UNION = f"{_TYPO}, u AS (SELECT DISTINCT name, tld, label, added_day, seed_value, sim FROM ({_NEAR}) WHERE sim >= {_LIMIT.format('seed_value')} OR contains(label, seed_value) OR (label, seed_value) IN (SELECT variant, x FROM v WHERE variant <> x))"


@query("JOB05_brand_scan_typo_ring", _with_seeds("SELECT 1").removesuffix(" SELECT 1") + f", {_TYPO_UNION}, {_SCAN} {_SCAN_COLUMNS}")
def job05_typo_ring(spark, d):
    """The scan with the brands' typo variants among the candidates."""
    variants = C.typo_variants(V.brand(spark), "brand_label", KEYS).withColumnRenamed("brand_label", "seed_value")
    found = C.brand_scan(V.zone_today(spark, d), _seeds(spark, d), as_of(), variants=variants)
    return found.select("brand_id", "name", "seed_value", "score_final", "risk_level", "matched_rule", F.array_join("reasons", ",").alias("reasons"), "actionability_score", "attention_bucket")


@query("FN17_actionability", with_scan(f"SELECT brand_id, name, {_Q4.format('act')} AS actionability_score, attention_bucket FROM best"))
def fn17(spark, d):
    return scan(spark, d).select("brand_id", "name", "actionability_score", "attention_bucket")


@query("WIN06_best_seed_per_domain", with_scan("SELECT brand_id, name, seed_type, seed_value FROM best"))
def win06(spark, d):
    return scan(spark, d).select("brand_id", "name", "seed_type", "seed_value")


@query("FN19_disposition_pre", with_scan("SELECT brand_id, name, CASE attention_bucket WHEN 'immediate_attention' THEN 'live_but_unknown' WHEN 'defensive_gap' THEN 'defensive_gap' ELSE 'inconclusive' END AS disposition FROM best"))
def fn19(spark, d):
    return scan(spark, d).select("brand_id", "name", "disposition")


@query("SRT01_triage_order", with_scan(f"SELECT brand_id, name, score_final FROM best ORDER BY CASE attention_bucket WHEN 'immediate_attention' THEN 0 WHEN 'defensive_gap' THEN 1 ELSE 2 END, {_Q4.format('act')} DESC, score_final DESC, name, brand_id LIMIT 100"))
def srt01(spark, d):
    return triage_page(scan(spark, d), 0, 100).select("brand_id", "name", "score_final")


def triage_page(matches: DataFrame, offset: int, limit: int) -> DataFrame:
    return matches.orderBy(*C.triage_order(matches), "brand_id").offset(offset).limit(limit)


@query("JON08_brand_left_agg", with_scan("SELECT b.brand_id, count(m.name) AS matches, count(*) FILTER (WHERE m.attention_bucket = 'immediate_attention') AS immediate, max(m.score_final) AS top_score FROM brand b LEFT JOIN best m ON b.brand_id = m.brand_id GROUP BY b.brand_id"))
def jon08(spark, d):
    m = scan(spark, d).select("brand_id", "name", "attention_bucket", "score_final")
    return V.brand(spark).select("brand_id").join(m, "brand_id", "left").groupBy("brand_id").agg(F.count("name").alias("matches"), F.count_if(F.col("attention_bucket") == "immediate_attention").alias("immediate"), F.max("score_final").alias("top_score"))


_BUDGET = f"""a AS (SELECT brand_id, name, attention_bucket = 'immediate_attention' AS now, {_Q4.format("act")} AS act4, score_final, CASE WHEN {V._SHARD.format("name", 7)} = 0 OR {V._SHARD.format("name", 5)} = 0 THEN 9
  WHEN attention_bucket = 'immediate_attention' THEN 0 WHEN added_day = 20240131 THEN 1 WHEN attention_bucket = 'defensive_gap' THEN 2 WHEN attention_bucket = 'watchlist' AND score_final > 0.55 THEN 3
  WHEN {V._SHARD.format("name", 3)} = 0 OR added_day < 20240124 THEN 4 ELSE 5 END AS tier FROM best),
t AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY tier, act4 DESC NULLS LAST, score_final DESC, name) AS r FROM a),
g AS (SELECT brand_id, name, CASE WHEN tier = 0 OR (tier < 9 AND r <= 50) THEN r END AS budget_rank FROM t)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """The scan's matches by enrichment budget: a seventh are settled, a fifth dismissed, a third never enriched, the others when they were added."""
    day, shard = L.int_date(F.col("added_day")), lambda n: L.stable_shard(F.col("name"), n)
    m = scan(spark, d).withColumns({"auto_disposition": F.when(shard(7) == 0, "self_owned"), "disposition": F.when(shard(5) == 0, "dismissed").otherwise("inconclusive"), "first_detected": day, "last_enriched": F.when(shard(3) != 0, day)})
    return budget_rank(m, 50, as_of())


@query("WIN04_budget_rank", with_scan("SELECT 1").removesuffix(" SELECT 1") + f", {_BUDGET} SELECT * FROM g")
def win04(spark, d):
    return _ranked(spark, d).select("brand_id", "name", "budget_rank")


@query("SRT11_ranked_fetch", with_scan("SELECT 1").removesuffix(" SELECT 1") + f", {_BUDGET} SELECT * FROM g WHERE budget_rank <= 10")
def srt11(spark, d):
    return _ranked(spark, d).filter("budget_rank <= 10").select("brand_id", "name", "budget_rank")



def flagship(spark: SparkSession, d: str) -> DataFrame:
    return triage_page(scan(spark, d), 0, 200)
