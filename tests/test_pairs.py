"""Scores of every name with every brand: what is computed once, and odd labels against plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from zonewright.functions import labels as L
from zonewright.functions import scores as S
from zonewright.plans import catalogue

SCORES = ("FN11_composite_score", "FN13_reasons", "FN16_matched_rule", "FN14_seeded_score", "FN15_seeded_risk", "FN12_risk_level", "FN10_keyword_score")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", (*SCORES, "FN09_keyword_hits"))
def test_tokens_are_cut_once_for_a_pair(spark, sf_dir, name):
    """Beside one list of keywords each: not once more for every keyword and use."""
    assert plan_of(catalogue.queries()[name](spark, sf_dir)).count("regexp_extract_all") == 2


@pytest.mark.parametrize("name", ("FN11_composite_score", "FN13_reasons"))
def test_trigrams_of_a_name_stand_below_the_pairs(spark, sf_dir, name):
    plan = plan_of(catalogue.queries()[name](spark, sf_dir))
    assert plan.index("BroadcastNestedLoopJoin") < plan.index("transform(sequence(1, (length(") and "array_distinct" not in plan[: plan.index("BroadcastNestedLoopJoin")]


@pytest.mark.parametrize("name", ("FN16_matched_rule", "FN14_seeded_score", "FN15_seeded_risk"))
def test_what_a_name_has_of_its_own_stands_below_the_pairs(spark, sf_dir, name):
    """Look-alikes, risk words and channels: by name or brand, not by pair."""
    plan = plan_of(catalogue.queries()[name](spark, sf_dir))
    pairs = plan[: plan.index("BroadcastNestedLoopJoin")]
    assert not any(x in pairs for x in ("translate(", "md5(", "account"))


@pytest.mark.parametrize("name", ("FN14_seeded_score", "FN15_seeded_risk"))
def test_a_pair_meets_no_sets_and_one_distance_twice(spark, sf_dir, name):
    """Of trigrams only the brand's few are looked for in a name's text; of distances that of the plain texts is made once."""
    plan = plan_of(catalogue.queries()[name](spark, sf_dir))
    pairs = plan[: plan.index("BroadcastNestedLoopJoin")]
    assert "array_intersect" not in pairs and pairs.count("levenshtein(") == 2


def test_seeded_risk_makes_no_list_of_reasons(spark, sf_dir):
    assert "exact_label_match" not in plan_of(catalogue.queries()["FN15_seeded_risk"](spark, sf_dir))


def test_seeded_risk_of_conditions_is_that_of_reasons(spark):
    rows = [(t, b, k, h, x, y, c) for t in (0.0, 1.0) for b in (0.0, 1.0) for k in (0.0, 0.3, None) for h in (0.5, 0.95, 1.0, None) for x in (True, False, None) for y in (0.5, 0.57, 0.59, 0.61, 0.65, 0.79) for c in ("certificate_hostname", "both")]
    df = spark.createDataFrame(rows, "t double, b double, k double, h double, x boolean, y double, c string")
    s = S.Signals(*map(F.col, "thbkhx"))
    risks = [S.seeded_risk(F.col("y"), why, F.col("c")) for why in (S.reasons(s), S.conditions(s))]
    assert df.filter(~risks[0].eqNullSafe(risks[1])).count() == 0


def test_trigrams_are_counted_in_padded_words(spark):
    words = ["thatin", "aaaa", "abcabc", "ananas", "a", "", "-", "-a", "a-b", "that.that", "TH4TIN", "at  in", "é", "thé", " t", "x" * 63, None]
    df = spark.createDataFrame([(x, y) for x in words for y in words], "x string, y string")
    w, gs = L.padded(F.col("x")), L.trigrams(F.col("y"))
    found = L.counted_similarity(L.padded_shared(w, gs), L.padded_count(w), F.size(gs))
    for r in df.select("x", "y", L.padded_count(w).alias("n"), found.alias("sim"), L.trigram_similarity(F.col("x"), F.col("y")).alias("old")).collect():
        if r.x is None or r.y is None:
            assert r.sim is None and r.old is None
            continue
        a, b = set(L.trigrams_of(r.x)), set(L.trigrams_of(r.y))
        assert r.n == len(a) and r.sim == r.old == (len(a & b) / len(a | b) if a | b else 0.0)


def test_keywords_with_blanks_around_a_brand(spark):
    """The blank in a brand's place counts for them."""
    rows = [(x, b, k) for x in ("logpayin", "log in", "login", "payin", None) for b in ("pay", "", None) for k in (["log in"], ["in", "log in", None], ["log in", ""], [])]
    df = spark.createDataFrame(rows, "x string, b string, k array<string>")
    for r in df.select("x", "b", "k", L.keyword_hits(F.col("x"), F.col("b"), F.col("k")).alias("n")).collect():
        if None in (r.x, r.b):
            assert r.n == 0
            continue
        text = r.x.replace(r.b, " ") if r.b else r.x
        assert r.n == sum(bool(k) and (k in re.findall("[a-z0-9]+", text) or (len(k) > 4 and k in text)) for k in r.k)


def test_signals_of_columns_at_hand(spark):
    labels = ["thatin", "th4tin", "THATIN", "pay-thatin", "thatinlogin", "login", "my-bank", "authatin", "auth-thatin", "b4nk.thatin", "", None]
    rows = [(x, b, k) for x in labels for b in ("thatin", "th4tin", "", None) for k in (["login", " Pay "], [], None)]
    df = spark.createDataFrame(rows, "x string, b string, k array<string>")
    x, b, k, t = F.col("x"), F.col("b"), F.col("k"), F.lit(0.5)
    plain, base = L.unmasked(x), L.unmasked(b)
    fields = lambda s: F.struct(s.edit, s.brand, s.keyword, s.homograph, s.exact)
    for r in df.select("x", "b", "k", fields(S.signals(x, b, k, t)).alias("whole"), fields(S.signals(x, b, k, t, plain, base, S.risk_words(plain))).alias("held"), L.normalized_levenshtein(x, b).alias("edit"), L.keyword_hits(plain, base, F.array(*map(F.lit, S.RISK_WORDS))).alias("risk"), L.keyword_hits(plain, base, k).alias("own")).collect():
        assert r.whole == r.held and r.whole[0] == r.edit
        assert r.whole[2] == (1.0 if r.own is None else min(1.0, r.risk * 0.3 + r.own * 0.2))


def test_hits_and_boundaries_of_odd_labels(spark):
    labels = ["pay", "my-pay", "pay-login", "loginpay", "xbankx", "a.b+c", "(x", "", None, "épay", "payé", "PAYlogin"]
    lists = [["login", " Pay ", ""], [], ["bank", "a", None], None]
    rows = [(x, b, k) for x in labels for b in ("pay", "", "a.b", "(x", None) for k in lists]
    df = spark.createDataFrame(rows, "x string, b string, k array<string>")
    x, b, k = F.col("x"), F.col("b"), F.col("k")
    for r in df.select("x", "b", "k", L.keyword_hits(x, b, k).alias("n"), L.brand_boundary(x, b).alias("at")).collect():
        if r.k is None or r.x is None or r.b is None:
            assert r.n == (None if r.k is None else 0)
            continue
        text = r.x.replace(r.b, " ") if r.b else r.x
        tokens = re.findall("[a-z0-9]+", text)
        keys = [y.lower().strip() for y in r.k if y is not None]
        assert r.n == sum(bool(y) and (y in tokens or (len(y) > 4 and y in text)) for y in keys)
        edge = any(not (i and r.x[i - 1].isalpha()) or not r.x[i + len(r.b) : i + len(r.b) + 1].isalpha() for i in range(len(r.x)) if r.b and r.x.startswith(r.b, i))
        assert r.at == edge
