"""Encoded names against the codec and known attacks."""

import unicodedata

from pyspark.sql import functions as F

from zonewright.functions import idna as I
from zonewright.operators import candidates as C
from zonewright.plans import catalogue, search


def test_labels_are_encoded_and_decoded(spark):
    rows = ["google", " Bücher ", "naïve", "", None, "ñandú", "x" * 70, "é" * 70, "xn--bcher-kva", "xn--é", "xn--zzzzzzzzzzz99999"]
    d = spark.createDataFrame([(r,) for r in rows], "x string")
    got = [tuple(r) for r in d.select("x", I.idna_encode(F.col("x")), I.idna_decode(F.col("x"))).collect()]
    for x, enc, dec in got:
        if x is None:
            assert (enc, dec) == (None, None)
            continue
        y = x.strip().lower()
        try:
            want = y if y.isascii() else y.encode("idna").decode()
        except UnicodeError:
            want = ""
        assert enc == want
        try:
            back = y.encode("ascii").decode("idna") if y.startswith("xn--") else y
        except UnicodeError:
            back = y
        assert dec == back


def test_known_attacks_are_unmasked(spark):
    rows = [("xn--brdesco-3fg", "bradesco"), ("xn--gogle-jye", "google"), ("xn--gogle-rce", "google"), ("xn--pypal-4ve", "paypal"), ("g00gle", "google")]
    d = spark.createDataFrame(rows, "label string, brand string")
    assert all(r[0] == r[1] for r in d.select(I.homograph_normalize(I.idna_decode(F.col("label"))), "brand").collect())
    brands = spark.createDataFrame([(1, "google", "standard", ["login"])], "brand_id int, brand_label string, noise_mode string, keywords array<string>")
    seeds = brands.select("brand_id", F.col("brand_label").alias("seed_value"), "brand_label", "keywords", "noise_mode", F.lit("domain_label").alias("seed_type"), F.lit("registrable_domain").alias("channel_scope"), F.lit(1.0).alias("base_weight"))
    names = spark.createDataFrame([("xn--gogle-jye.com", "com", "xn--gogle-jye", 20240120), ("other.com", "com", "other", 20240120)], "name string, tld string, label string, added_day int")
    found = C.encoded_candidates(names, brands).select("name", "tld", "label", "added_day", F.col("brand_label").alias("seed_value"), F.lit(0.1).alias("sim"))
    r = C.scored(found, seeds, F.lit("2024-01-31").cast("date"), I.idna_decode(F.col("label")), I.homograph_normalize).collect()
    assert [(x.name, x.score_homograph, x.matched_rule) for x in r] == [("xn--gogle-jye.com", 1.0, "homograph")]
    made = {x.seed_value for x in C.homograph_seeds(brands, I.LOOKALIKES).collect()}
    assert "xn--gogle-jye" in made and len(made) == 7  # o has two look-alikes, twice; l one, e two
    assert len(C.homograph_seeds(brands, I.LOOKALIKES, 1).collect()) == 2


def test_queries_on_encoded_names(spark, sf_dir):
    q = catalogue.queries()
    words = [r.word for r in search.word(spark, sf_dir).collect()]
    assert words and all(not w.isascii() for w in words)
    for r in q["FN06_homograph_whole"](spark, sf_dir).collect():
        bare = "".join(c for c in unicodedata.normalize("NFKD", r.word) if not unicodedata.combining(c)).lower()
        assert r.plain == "".join({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}.get(c, I.LOOKALIKES.get(c, c)) for c in bare)
    assert {r.word: r.label for r in q["FN04_idna_encode"](spark, sf_dir).collect()} == {w: I._encode(w) for w in words}
    assert all(not r.decoded.startswith("xn--") for r in q["FN05_idna_decode"](spark, sf_dir).collect())
    attacks = [r for r in q["JOB03_ring_c_punycode"](spark, sf_dir).collect() if r.score_homograph == 1.0]
    assert attacks and all(r.matched_rule in ("homograph", "typo_candidate") for r in attacks)
    assert q["GEN04_homograph_seeds"](spark, sf_dir).count() > 0


def test_each_word_is_encoded_once(spark, sf_dir, monkeypatch):
    """What encodes words stands above the distinct, and nothing that is read later encodes them again."""
    written = []
    real = search.Z.stored
    monkeypatch.setattr(search.Z, "stored", lambda df, name: written.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    zone = search.zone_idn(spark, sf_dir)
    plan = dict(written)["encoded-words"]
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("HashAggregate")
    assert "documents" not in zone._jdf.queryExecution().executedPlan().toString()
