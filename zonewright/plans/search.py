"""Queries on encoded names, the rings of a scan one by one, and the search for names like one domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import idna as I
from ..functions import labels as L
from ..functions import scores as S
from ..operators import candidates as C
from ..operators import profiles as P
from ..operators.search import Search, search_page, search_results
from ..sources import zones as Z
from . import views as V
from .names import _BOUND, _CLOSE, _LIMIT, _NEAR, _PLAIN, _Q4, _TYPO, KEYS, _seeds, _sim, _with_seeds, as_of
from .register import query


def word(spark: SparkSession, d: str) -> DataFrame:
    """Different words beyond ASCII, in lower case, of the documents."""
    # A word's ASCII beginning, a letter beyond, the rest: ASCII words are passed over, not made.
    pattern = r"(?<![a-z0-9])[a-z0-9]*+[\p{L}\p{N}&&[^\x00-\x7F]][\p{L}\p{N}]*+"
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("word")
    return V.table(spark, d, "documents").select(words).distinct()


def zone_idn(spark: SparkSession, d: str) -> DataFrame:
    """Names with encoded labels: the documents' words beyond ASCII, and the brands in look-alike letters."""
    # Encoded before the filter looks at it, which Spark would else move below distinct: every occurrence of a word would be encoded.
    words = Z.stored(word(spark, d).select(I.idna_encode(F.col("word")).alias("label")), "encoded-words")
    rows = words.unionByName(C.homograph_seeds(V.brand(spark), I.LOOKALIKES, 10**6).select(F.col("seed_value").alias("label"))).filter(F.startswith("label", F.lit("xn--"))).distinct()
    tld = F.element_at(F.array(*map(F.lit, V.TLDS)), L.stable_shard(F.col("label"), 4) + 1)
    rows = rows.withColumn("tld", tld).withColumn("name", F.concat_ws(".", "label", "tld"))
    return rows.withColumn("added_day", L.stable_shard(F.col("name"), 31) + 20240101)


@query("FN04_idna_encode")
def fn04(spark, d):
    return word(spark, d).select("word", I.idna_encode(F.col("word")).alias("label"))


@query("FN05_idna_decode")
def fn05(spark, d):
    return zone_idn(spark, d).select("name", I.idna_decode(F.col("label")).alias("decoded"))


@query("FN06_homograph_whole")
def fn06(spark, d):
    return word(spark, d).select("word", I.homograph_normalize(F.col("word")).alias("plain"))


@query("GEN04_homograph_seeds")
def gen04(spark, d):
    return C.homograph_seeds(V.company(spark, d), I.LOOKALIKES)


@query("JOB03_ring_c_punycode")
def job03(spark, d):
    """Encoded names, decoded and held against each brand's heaviest seed, with every score."""
    seeds = _seeds(spark, d).filter("seed_type = 'domain_label'")
    found = C.encoded_candidates(zone_idn(spark, d), V.brand(spark)).select("name", "tld", "label", "added_day", F.col("brand_label").alias("seed_value"))
    found = found.withColumn("sim", L.trigram_similarity(F.col("label"), F.col("seed_value")))
    s = C.scored(found, seeds, as_of(), I.idna_decode(F.col("label")), I.homograph_normalize)
    return s.select("brand_id", "name", "score_homograph", "score_final", "risk_level", "matched_rule", F.array_join("reasons", ",").alias("reasons"))


# The rings over the brands' own seeds; planted are names of typos and combinations, since few occur in the documents.
_PLANTED = """zp AS (SELECT * FROM n UNION ALL SELECT label || '.com', 'com', label, 20240115 FROM (SELECT unnest([brand_label || 'login', 'pay' || brand_label, substr(brand_label, 1, 2) || substr(brand_label, 4)]) AS label FROM brand) WHERE label NOT IN (SELECT label FROM n))"""


def _planted(spark: SparkSession, d: str) -> DataFrame:
    z = C.without_subdomains(V.zone_today(spark, d))
    b = F.col("brand_label")
    more = V.brand(spark).select(F.explode(F.array(F.concat(b, F.lit("login")), F.concat(F.lit("pay"), b), F.concat(F.substr(b, F.lit(1), F.lit(2)), F.substr(b, F.lit(4))))).alias("label"))
    more = more.join(z.select("label"), "label", "left_anti")
    return z.unionByName(more.select(F.concat("label", F.lit(".com")).alias("name"), F.lit("com").alias("tld"), "label", F.lit(20240115).alias("added_day")))


_TYPO_SEEDS = "ts AS (SELECT brand_id, variant AS seed_value FROM (SELECT x, variant, row_number() OVER (PARTITION BY x ORDER BY length(variant), variant) AS r FROM (SELECT DISTINCT x, variant FROM v WHERE variant <> x AND length(variant) >= 3)) JOIN brand ON x = brand_label WHERE r <= 50)"


@query("JOB01_ring_a_exact", _with_seeds("SELECT 1").removesuffix(" SELECT 1") + f", {_PLANTED}, {_TYPO}, {_TYPO_SEEDS} SELECT zp.name, ts.brand_id, ts.seed_value FROM zp JOIN ts ON zp.label = ts.seed_value")
def job01(spark, d):
    seeds = C.typo_seeds(V.brand(spark), KEYS)
    return C.exact_candidates(_planted(spark, d), seeds).select("name", "brand_id", "seed_value")


_RING_B = f"""{_TYPO}, u AS (SELECT DISTINCT name, tld, label, added_day, seed_value, sim FROM ({_NEAR.replace('FROM n,', 'FROM zp n,')}) WHERE sim >= {_LIMIT.format('seed_value')} OR contains(label, seed_value) OR (label, seed_value) IN (SELECT variant, x FROM v WHERE variant <> x)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_value, tld ORDER BY sim DESC, name) AS r FROM u)"""


@query("JOB02_ring_b_fuzzy", _with_seeds("SELECT 1").removesuffix(" SELECT 1") + f", {_PLANTED}, {_RING_B} SELECT name, seed_value, sim FROM r WHERE r <= (SELECT greatest(250, least(1500, 5000 // count(DISTINCT seed_value))) FROM seed)")
def job02(spark, d):
    names, seeds = _planted(spark, d), _seeds(spark, d).select("seed_value").distinct()
    variants = C.typo_variants(V.brand(spark), "brand_label", KEYS).withColumnRenamed("brand_label", "seed_value")
    ring = C.trigram_candidates(names, seeds).unionByName(C.substring_candidates(names, seeds)).unionByName(C.typo_candidates(names, variants))
    return C.per_seed_limit(C.best_by_name(ring), C.seed_limit(seeds.count())).select("name", "seed_value", "sim")


_WORDS_SQL = "list_concat(list_concat([" + ", ".join(f"'{w}'" for w in S.RISK_WORDS) + "], keywords), [" + ", ".join(f"'{w}'" for w in P.SUFFIXES) + "])"
_COMBO_SEEDS = f"cw AS (SELECT brand_id, brand_label AS b, unnest({_WORDS_SQL}) AS w FROM brand), cs AS (SELECT brand_id, b || w AS seed_value, CAST(0.75 AS DOUBLE) AS weight FROM cw UNION SELECT brand_id, w || b, CAST(0.70 AS DOUBLE) FROM cw UNION SELECT brand_id, unnest([{', '.join(repr(p) for p in P.PREFIXES)}]) || brand_label, CAST(0.70 AS DOUBLE) FROM brand)"


@query("JOB04_ring_d_combo", _with_seeds("SELECT 1").removesuffix(" SELECT 1") + f", {_PLANTED}, {_COMBO_SEEDS} SELECT zp.name, brand_id, seed_value, max(weight) AS weight FROM zp JOIN cs ON zp.label = cs.seed_value GROUP BY ALL")
def job04(spark, d):
    cores = V.brand(spark).select("brand_id", F.array("brand_label").alias("cores"), "keywords")
    found = C.exact_candidates(_planted(spark, d), P.combo_seeds(cores))
    return found.groupBy("name", "brand_id", "seed_value").agg(F.max("base_weight").alias("weight"))


# Encoded names that read like the domain that is looked for, with what SQL can't derive: how they are read, the letters that they stand for,
# and how close they are to it as they are read.
_SOUGHT = "thatin"
_READ = ("th\u0430tin", "th\u00e4tin", "that\u00edn", "that\u0131n", "thatin-l\u00f6gin", "th\u0430tin-pay", "\u0165hatin", "tha\u0165in-secure", "my-th\u03b1tin", "th\u0430ting", "\u00f6ther")


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _encoded(read: str) -> str:
    return read.encode("idna").decode("ascii")


def zone_search(spark: SparkSession, d: str) -> DataFrame:
    """zone_today, in which names that begin with `the` are encoded beyond repair, and names that read like the sought one."""
    z = V.zone_today(spark, d)
    label = F.when(F.startswith("label", F.lit("the")), F.concat(F.lit("xn--"), F.col("label"), F.lit("-_"))).otherwise(F.col("label"))
    z = z.withColumn("label", label).withColumn("name", F.concat_ws(".", "label", "tld"))
    tlds = F.explode(F.array(F.lit("com"), F.lit("net")))
    more = spark.createDataFrame([(_encoded(r), 20240101 + i) for i, r in enumerate(_READ)], "label string, added_day int").withColumn("tld", tlds)
    return z.unionByName(more.select(F.concat_ws(".", "label", "tld").alias("name"), "tld", "label", "added_day"))


_READ_SQL = "(VALUES " + ", ".join(f"('{_encoded(r)}', {20240101 + i}, '{r}', '{I.plain_letters(r)}', CAST({1 - _edits(r, _SOUGHT) / max(len(r), len(_SOUGHT))!r} AS DOUBLE))" for i, r in enumerate(_READ)) + ") p(label, added_day, shown, plain, near)"
_LOOKS_SQL = ", ".join(sorted({f"'{_encoded(_SOUGHT[:i] + look + _SOUGHT[i + 1 :])}'" for i, c in enumerate(_SOUGHT) for look, letter in I.LOOKALIKES.items() if letter == c}))


def _search_sql(asked: Search) -> str:
    """The whole search up to its results r: one row for each name, with total and place."""
    lexical = []
    if asked.fuzzy:
        lexical += [f"t >= {0.5 if len(_SOUGHT) <= 5 else 0.3}", "contains(label, brand_label)"]
    if asked.typo:
        lexical += ["label IN (SELECT variant FROM v WHERE variant <> x)", f"label IN ({_LOOKS_SQL})"]
    kept = ["TRUE"]
    if asked.tld_allowlist:
        kept.append(f"tld IN ({', '.join(repr(t) for t in asked.tld_allowlist)})")
    if not asked.include_subdomains:
        kept.append("NOT contains(label, '.')")
    base = _PLAIN.format("brand_label")
    risky = ", ".join(repr(w) for w in S.RISK_WORDS)
    score = {"hybrid": "whole", "fuzzy": "fz", "typo": "ty", "both": "greatest(fz, ty)"}["hybrid" if "hybrid" in asked.algorithms else "both" if len(asked.algorithms) == 2 else asked.algorithms[0]]
    official = f"{_SOUGHT}.com"
    zone = V.sql("SELECT 1", "zone_today").removesuffix(" SELECT 1")
    return f"""{zone}, brand AS (SELECT '{_SOUGHT}' AS brand_label), {_TYPO}, p AS (SELECT * FROM {_READ_SQL}),
y AS (SELECT tld, added_day, CASE WHEN starts_with(label, 'the') THEN 'xn--' || label || '-_' ELSE label END AS label FROM zone_today UNION ALL SELECT unnest(['com', 'net']), added_day, label FROM p),
z AS (SELECT y.*, label || '.' || tld AS name, brand_label FROM y, brand WHERE {" AND ".join(kept)}),
q AS (SELECT *, {_sim("label", "brand_label")} AS t FROM z),
lexical AS (SELECT * FROM q WHERE {" OR ".join(lexical)} ORDER BY t DESC, added_day DESC, name LIMIT {asked.scanned}),
encoded AS (SELECT * FROM q WHERE starts_with(label, 'xn--') ORDER BY added_day DESC NULLS LAST, name LIMIT {asked.scanned}),
m AS (SELECT m.*, coalesce(p.shown, m.label) AS shown, coalesce(p.plain, {_PLAIN.format("m.label")}) AS plain, coalesce(p.near, {_CLOSE.format("m.label", "brand_label")}) AS near
  FROM (SELECT * FROM lexical UNION SELECT * FROM encoded) m LEFT JOIN p ON p.label = m.label),
s AS (SELECT *, greatest(near, {_CLOSE.format("plain", base)}) AS e, CASE WHEN {_BOUND.format("plain", base)} THEN 1.0 ELSE 0.0 END AS b, {_CLOSE.format("plain", base)} AS h, shown = brand_label AS x,
  replace(plain, {base}, ' ') AS rest FROM m),
k AS (SELECT *, least(1.0, len(list_filter([{risky}], lambda w: list_contains(regexp_extract_all(rest, '[a-z0-9]+'), w) OR (length(w) > 4 AND contains(rest, w)))) * CAST(0.3 AS DOUBLE)) AS k FROM s),
c AS (SELECT *, {_Q4.format("t * CAST(0.30 AS DOUBLE) + e * CAST(0.25 AS DOUBLE) + b * CAST(0.20 AS DOUBLE) + k * CAST(0.15 AS DOUBLE) + h * CAST(0.10 AS DOUBLE)")} AS whole,
  greatest({_Q4.format("t")}, {_Q4.format("b")}) AS fz, greatest({_Q4.format("e")}, {_Q4.format("h")}) AS ty FROM k),
w AS (SELECT *, {score} AS score, name = '{official}' AS is_official, list_filter([CASE WHEN x THEN 'exact_label_match' END, CASE WHEN NOT x AND e >= 0.75 AND t >= 0.45 THEN 'typosquatting' END,
  CASE WHEN b >= 1 AND NOT x THEN 'brand_containment' END, CASE WHEN k > 0 THEN 'risky_keywords' END, CASE WHEN NOT x AND h >= 0.95 AND h > t THEN 'homograph_attack' END], lambda y: y IS NOT NULL) AS found FROM c),
r AS (SELECT name AS domain, score, fz AS fuzzy, ty AS typo, CASE WHEN len(found) = 0 THEN 'lexical_similarity' ELSE array_to_string(found, ',') END AS reasons,
  CAST(strptime(CAST(added_day AS VARCHAR), '%Y%m%d') AS DATE) AS observed_at, CASE WHEN is_official THEN 'official' ELSE 'third_party_unknown' END AS ownership,
  CASE WHEN is_official THEN 'official' WHEN list_contains(found, 'exact_label_match') AND tld IN ({", ".join(repr(t) for t in S.STRATEGIC)}) THEN 'defensive_gap' WHEN score >= 0.72 THEN 'live_but_unknown' ELSE 'watchlist' END AS disposition,
  row_number() OVER (ORDER BY score DESC, added_day DESC, name DESC) AS place, count(*) OVER () AS total
  FROM w WHERE score >= {asked.min_score}{" AND NOT is_official" if asked.exclude_official else ""})"""


_PAGE = Search(_SOUGHT + ".com", ("hybrid",), 0.3, offset=5)
_ALL = Search("www.ThatIn.com", ("fuzzy", "typo"), 0.5, max_results=2000, exclude_official=True, tld_allowlist=("com", "net"))
_TYPOS = Search(_SOUGHT + ".com", ("typo",), 0.5, include_subdomains=True)
_RESULT_SQL = "domain, score, fuzzy, typo, reasons, observed_at, ownership, disposition"


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("domain", "score", "fuzzy", "typo", F.array_join("reasons", ",").alias("reasons"), "observed_at", "ownership", "disposition", *more)


@query("JOB06_domain_search", _search_sql(_PAGE) + f" SELECT {_RESULT_SQL}, total, total > {_PAGE.offset + _PAGE.max_results} AS has_more FROM r WHERE place BETWEEN {_PAGE.offset + 1} AND {_PAGE.offset + _PAGE.max_results}")
def job06(spark, d):
    """One page of the hybrid search."""
    return _shown(search_page(zone_search(spark, d), _PAGE, KEYS), "total", "has_more")


@query("FN21_search_disposition", _search_sql(_ALL) + " SELECT domain, score, disposition FROM r")
def fn21(spark, d):
    """All results among two endings, without the official domain."""
    return search_results(zone_search(spark, d), _ALL, KEYS).select("domain", "score", "disposition")


@query("FN20_search_scores", _search_sql(_TYPOS) + f" SELECT {_RESULT_SQL} FROM r")
def fn20_typo(spark, d):
    """Typos and encoded names alone, sub-domains among them."""
    return _shown(search_results(zone_search(spark, d), _TYPOS, KEYS))
