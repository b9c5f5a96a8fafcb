"""Queries on matches: gates, dispositions, reviews, and counts by brand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import candidates as C
from ..operators import enrichment as E
from . import views as V
from .names import _with_seeds, scan, with_scan
from .register import query

_SHARD = V._SHARD.format("name", 4)
_REVIEW_SQL = f"(['new','dismissed','confirmed_threat','new'])[{_SHARD} + 1]"


def _review():
    return V._pick(("new", "dismissed", "confirmed_threat", "new"), L.stable_shard(F.col("name"), 4))


@query("FLT08_auto_enrich_gate", with_scan("SELECT brand_id, name, CASE WHEN attention_bucket = 'watchlist' THEN false WHEN matched_rule IN ('typo_candidate', 'homograph', 'brand_plus_keyword') THEN true WHEN matched_rule = 'exact_label_match' AND seed_type = 'domain_label' THEN true WHEN attention_bucket = 'defensive_gap' THEN score_final >= 0.55 ELSE score_final >= 0.72 AND risk_level IN ('high', 'critical') END AS enrich FROM best"))
def flt08(spark, d):
    return scan(spark, d).select("brand_id", "name", E.auto_enrich(F.col("matched_rule"), F.col("seed_type"), F.col("attention_bucket"), F.col("score_final"), F.col("risk_level")).alias("enrich"))


@query("FLT09_llm_gate", with_scan("SELECT brand_id, name FROM best WHERE risk_level IN ('medium', 'high', 'critical') OR attention_bucket IN ('immediate_attention', 'defensive_gap')"))
def flt09(spark, d):
    return scan(spark, d).filter(F.col("risk_level").isin("medium", "high", "critical") | F.col("attention_bucket").isin("immediate_attention", "defensive_gap")).select("brand_id", "name")


@query("AGG04_brand_buckets", with_scan("SELECT brand_id, count(*) AS total, count(*) FILTER (WHERE attention_bucket = 'immediate_attention') AS immediate, max(added_day) AS last_day, max(score_final) AS top_score FROM best GROUP BY brand_id"))
def agg04(spark, d):
    return scan(spark, d).groupBy("brand_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("attention_bucket") == "immediate_attention").alias("immediate"), F.max("added_day").alias("last_day"), F.max("score_final").alias("top_score"))


@query("JON07_brand_match_inner", with_scan("SELECT m.name, b.brand_label, b.noise_mode FROM best m JOIN brand b ON m.brand_id = b.brand_id"))
def jon07(spark, d):
    return scan(spark, d).select("brand_id", "name").join(F.broadcast(V.brand(spark).select("brand_id", "brand_label", "noise_mode")), "brand_id").select("name", "brand_label", "noise_mode")


@query("JON12_missing_snapshot_anti", with_scan("SELECT brand_id, name FROM best WHERE name NOT IN (SELECT name FROM zone_today WHERE added_day % 2 = 0)"))
def jon12(spark, d):
    have = V.zone_today(spark, d).filter("added_day % 2 = 0").select("name")
    return scan(spark, d).select("brand_id", "name").join(have, "name", "left_anti").select("brand_id", "name")


@query("SET03_rank_union_all", with_scan("SELECT brand_id, name, 1 AS part FROM best WHERE attention_bucket = 'immediate_attention' UNION ALL SELECT brand_id, name, 2 FROM best WHERE attention_bucket <> 'immediate_attention'"))
def set03(spark, d):
    m = scan(spark, d)
    now = F.col("attention_bucket") == "immediate_attention"
    return m.filter(now).select("brand_id", "name", F.lit(1).alias("part")).unionByName(m.filter(~now).select("brand_id", "name", F.lit(2).alias("part")))


@query("AGG11_assessment_progress", with_scan(f"SELECT brand_id, count(*) AS eligible, count(*) FILTER (WHERE {_REVIEW_SQL} <> 'new') AS completed FROM best WHERE attention_bucket <> 'watchlist' GROUP BY brand_id"))
def agg11(spark, d):
    return scan(spark, d).filter("attention_bucket <> 'watchlist'").groupBy("brand_id").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(_review() != "new").alias("completed"))


@query("SRT12_needs_assessment", with_scan(f"SELECT brand_id, name, score_final FROM best WHERE attention_bucket <> 'watchlist' AND {_REVIEW_SQL} <> 'dismissed' ORDER BY score_final DESC, name, brand_id LIMIT 50"))
def srt12(spark, d):
    return scan(spark, d).filter((F.col("attention_bucket") != "watchlist") & (_review() != "dismissed")).orderBy(F.desc("score_final"), "name", "brand_id").limit(50).select("brand_id", "name", "score_final")


@query("FN20_search_final_score", _with_seeds("SELECT name, CASE CAST(added_day % 3 AS INTEGER) WHEN 0 THEN greatest(f, t) WHEN 1 THEN f ELSE t END AS score FROM (SELECT name, added_day, length(label) / 63.0 AS f, CASE WHEN starts_with(label, 'th') THEN 1.0 ELSE 0.0 END AS t FROM n)"))
def fn20(spark, d):
    fuzzy, typo = F.length("label") / 63.0, F.when(F.startswith("label", F.lit("th")), 1.0).otherwise(0.0)
    algorithms = V._pick_array((("fuzzy", "typo"), ("fuzzy",), ("typo",)), F.col("added_day") % 3)
    return V.zone_today(spark, d).select("name", search_score(algorithms, fuzzy, typo).alias("score"))


def search_score(algorithms, fuzzy, typo):
    both = F.array_contains(algorithms, "fuzzy") & F.array_contains(algorithms, "typo")
    return F.when(both, F.greatest(fuzzy, typo)).when(F.array_contains(algorithms, "fuzzy"), fuzzy).otherwise(typo)


@query("WIN07_best_combo_seed", _with_seeds("SELECT name, seed_value FROM (SELECT n.name, s.seed_value, row_number() OVER (PARTITION BY n.name ORDER BY (n.label = s.seed_value) DESC, s.base_weight DESC, s.seed_value) AS r FROM n JOIN seed s ON contains(n.label, s.seed_value)) WHERE r = 1"))
def win07(spark, d):
    from .names import _seeds

    s = _seeds(spark, d).select("seed_value", "base_weight")
    j = C.substring_candidates(C.without_subdomains(V.zone_today(spark, d)), s).join(C.few(s), "seed_value")
    w = Window.partitionBy("name").orderBy(F.desc(F.col("label") == F.col("seed_value")), F.desc("base_weight"), "seed_value")
    return j.withColumn("r", F.row_number().over(w)).filter("r = 1").select("name", "seed_value")


@query("JON13_unchecked_domain_anti", V.sql("SELECT page_id, host FROM host WHERE host NOT IN (SELECT host FROM host WHERE page_id % 3 = 0) ORDER BY page_id LIMIT 10", "host"))
def jon13(spark, d):
    h = V.host(spark, d)
    return h.join(h.filter("page_id % 3 = 0").select("host"), "host", "left_anti").orderBy("page_id").limit(10).select("page_id", "host")
