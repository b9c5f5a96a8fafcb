"""Candidate joins against brute force, with seeds broadcast and shuffled."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewright.functions import labels as L
from zonewright.operators import candidates as C
from zonewright.operators.postings import Postings

NAMES = "name string, tld string, label string, added_day int"


def grams(x):
    return {w[i : i + 3] for p in re.findall("[a-z0-9]+", x.lower()) for w in [f"  {p} "] for i in range(len(w) - 2)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def threshold(seed):
    return 0.55 if len(seed) <= 5 else 0.45 if len(seed) <= 8 else 0.35


def words(rng, n):
    parts = ["pay", "bank", "login", "shop", "store", "web", "my", "secure", "ing", "ation", "-", "x", "a1"]
    return sorted({"".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(n)})


def zone(spark, labels):
    return spark.createDataFrame([(f"{x}.com", "com", x, i) for i, x in enumerate(labels)], NAMES)


@pytest.fixture(params=[True, False])
def broadcast(request, monkeypatch):
    if not request.param:
        monkeypatch.setattr(C, "FEW", 0)


def test_trigram_join(spark, broadcast):
    rng = np.random.default_rng(8)
    labels, seeds = [*words(rng, 1500), "--", "-", "é", ""], [*words(rng, 150), "---"]
    got = C.trigram_candidates(zone(spark, labels), spark.createDataFrame([(s,) for s in [*seeds, seeds[0]]], "seed_value string")).collect()
    want = {(f"{x}.com", s): similarity(x, s) for x in labels for s in seeds if similarity(x, s) >= threshold(s)}
    assert len(got) == len(want) > 1000
    assert all(abs(want[r.name, r.seed_value] - r.sim) < 1e-12 for r in got)


def test_posting_lists_follow_the_days(spark, tmp_path, broadcast):
    rng = np.random.default_rng(10)
    every, seeds = words(rng, 900), words(rng, 80)
    first, second, gone = every[:600], every[600:], every[::7]
    index = Postings.create(zone(spark, first), str(tmp_path / "index"))
    index.add(zone(spark, first), 1)
    index.add(zone(spark, second), 2)
    index.add(zone(spark, second), 2)
    index.remove(zone(spark, gone), 3)
    # One that was gone comes back.
    index.add(zone(spark, gone[:5]), 4)
    left = (set(every) - set(gone)) | set(gone[:5])
    s = spark.createDataFrame([(x,) for x in seeds], "seed_value string")
    got = Postings(spark, index.path, index.least).candidates(s).collect()
    want = {(f"{x}.com", y) for x in left for y in seeds if similarity(x, y) >= threshold(y)}
    assert len(got) == len(want) > 100 and {(r.name, r.seed_value) for r in got} == want
    assert index.candidates(s.limit(0)).collect() == []
    with pytest.raises(ValueError):
        index.candidates(s, F.lit(0.1))


def test_a_search_opens_the_folders_of_its_trigrams(spark, tmp_path):
    index = Postings.create(zone(spark, words(np.random.default_rng(11), 500)), str(tmp_path / "index"))
    index.add(zone(spark, words(np.random.default_rng(11), 500)), 1)
    found = index.candidates(spark.createDataFrame([("paybank",)], "seed_value string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_trigram_join_without_rows(spark):
    z, none = zone(spark, ["abc"]), spark.createDataFrame([], "seed_value string")
    assert C.trigram_candidates(z, none).collect() == [] and C.substring_candidates(z, none).collect() == []
    assert C.trigram_candidates(z.limit(0), spark.createDataFrame([("abc",)], "seed_value string")).collect() == []


def test_only_prefixes_are_exploded(spark, monkeypatch):
    """Names that share too little with any seed give no row; others give the first of their trigrams."""
    seen = []
    real = C._by_trigram
    monkeypatch.setattr(C, "_by_trigram", lambda n, s: seen.append(n.count()) or real(n, s))
    z = zone(spark, [*(f"nothing{i}" for i in range(100)), "bradescologin"])
    assert [r.name for r in C.trigram_candidates(z, spark.createDataFrame([("bradesco",)], "seed_value string")).collect()] == ["bradescologin.com"]
    # 14 trigrams, 8 of them the seed's, of which 7 must be shared.
    assert seen == [2]


def test_substring_join(spark, broadcast):
    rng = np.random.default_rng(9)
    labels = sorted({*words(rng, 1000), "", "a", "pay"})
    for seeds in (["pay", "ing", "x"], [*words(rng, 120), "a", "1", "ay", "pay", "", "-"]):
        got = C.substring_candidates(zone(spark, labels), spark.createDataFrame([(s,) for s in seeds], "seed_value string")).collect()
        want = {(f"{x}.com", s) for x in labels for s in set(seeds) if s and s in x}
        assert len(got) == len(want) and {(r.name, r.seed_value) for r in got} == want


def test_seeds_with_one_beginning_have_keys_of_their_own(spark, monkeypatch):
    """10,000 seeds that begin alike: no key holds more than a few of them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    seeds = [f"commonbeginning{a}{b}{c}" for a in letters for b in letters[:20] for c in letters[:20]][:10_000]
    seen = []
    real = C._by_trigram
    monkeypatch.setattr(C, "_by_trigram", lambda n, s: seen.append(s) or real(n, s))
    found = C.substring_candidates(zone(spark, ["xcommonbeginningabcx", "commonbeginning"]), spark.createDataFrame([(s,) for s in seeds], "seed_value string"))
    assert [(r.name, r.seed_value) for r in found.collect()] == [("xcommonbeginningabcx.com", "commonbeginningabc")]
    assert seen[0].groupBy("g").count().agg(F.max("count")).first()[0] <= 26


def test_similarity_to_one_text(spark):
    d = spark.createDataFrame([("google",), ("go ogle-x",), ("",), (None,)], "x string")
    for text in ("google", "--", "a"):
        rows = d.select(L.trigram_similarity_to(F.col("x"), text), L.trigram_similarity(F.col("x"), F.lit(text))).collect()
        assert all(a == b for a, b in rows)


def test_postings_cut_each_snapshot_from_the_texts_once(spark, sf_dir, monkeypatch):
    from zonewright.operators.postings import Postings
    from zonewright.plans import catalogue

    seen = []
    for step in ("add", "remove"):
        real = getattr(Postings, step)
        monkeypatch.setattr(Postings, step, lambda self, names, day, real=real: seen.append(names._jdf.queryExecution().toString()) or real(self, names, day))
    catalogue.queries()["JON05_trigram_postings"](spark, sf_dir)
    assert len(seen) == 3 and not any("documents.parquet" in p or "text#" in p for p in seen)
