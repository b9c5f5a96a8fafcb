from pyspark.sql import functions as F

from zonewright.functions import labels as L
from zonewright.functions import scores as S
from zonewright.operators import candidates as C
from zonewright.operators import lake as O
from zonewright.sources import zones as Z


def scored(spark, label, brand, keywords, sim):
    df = spark.createDataFrame([(label, brand, keywords, sim)], "label string, brand string, keywords array<string>, sim double")
    s = S.signals(F.col("label"), F.col("brand"), F.col("keywords"), F.col("sim"))
    return df.select(S.composite(s).alias("score"), S.risk_level(s, S.composite(s)).alias("risk"), S.reasons(s).alias("why"), s.brand.alias("hit"), s.keyword.alias("words")).first()


def test_exact_match_is_high_not_critical(spark):
    r = scored(spark, "google", "google", [], 1.0)
    assert (r.risk, "exact_label_match" in r.why) == ("high", True)


def test_brand_inside_a_word_is_no_hit(spark):
    r = scored(spark, "mckinneyavenuetransitauthority", "itau", ["auth", "login"], 0.31)
    assert (r.hit, r.words) == (0.0, 0.0)


def test_brand_with_risky_word_is_critical(spark):
    r = scored(spark, "google-login", "google", ["login"], 0.82)
    assert r.risk == "critical" and "risky_keywords" in r.why


def test_lookalike_digits(spark):
    df = spark.createDataFrame([("g00gle",)], "x string")
    assert df.select(L.unmasked(F.col("x"))).first()[0] == "google"


def test_registrable_parts(spark):
    df = spark.createDataFrame([("a.b.com.br",), ("a.b.com",), ("com",), (None,)], "x string")
    got = df.select(L.registrable_domain(F.col("x")), L.public_suffix(F.col("x")), L.hostname_stem(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("b.com.br", "com.br", "b.com"), ("b.com", "com", None), (None, None, None), (None, None, None)]


def test_candidates_without_rows(spark):
    names = spark.createDataFrame([], "name string, tld string, label string, added_day int")
    seeds = spark.createDataFrame([("brand",)], "seed_value string")
    assert C.trigram_candidates(names, seeds).count() == 0 and C.substring_candidates(names, seeds).count() == 0


def test_zone_file(spark, tmp_path):
    import gzip

    p = tmp_path / "com.txt.gz"
    p.write_bytes(gzip.compress("; c\n\nFoo.com. 86400 in ns x.\nfoo.com. 1 in ns y\n*.w.com. in a\ncom. in soa\na.b.com. in ns\nb\xe9.com. in a\nx.net. in a\n".encode("latin-1")))
    got = Z.zone_names(Z.read_lines(spark, str(p)), F.lit("com")).select("name").collect()
    assert sorted(r.name for r in got) == ["a.b.com", "b\xe9.com", "foo.com"]


def test_lenient_read_and_dynamic_write(spark, tmp_path):
    path = str(tmp_path / "lake")
    assert Z.lenient_read(spark, path, Z.SNAPSHOT).count() == 0
    day = lambda names, tld: spark.createDataFrame([(n, tld) for n in names], "name string, tld string")
    Z.write_lake(day(["a.com"], "com").union(day(["a.net"], "net")), path, "tld")
    Z.write_lake(day(["b.com"], "com"), path, "tld")
    got = Z.lenient_read(spark, path, Z.SNAPSHOT).collect()
    assert sorted((r.name, r.tld, r.label) for r in got) == [("a.net", "net", None), ("b.com", "com", None)]


def test_lifecycle_keeps_first_day_of_returning_names(spark):
    d = lambda x: F.lit(x).cast("date")
    today = spark.createDataFrame([("a.com", "com"), ("c.com", "com")], "name string, tld string")
    state = spark.createDataFrame([("a.com", "com", "2024-01-01", "2024-01-02", False), ("b.com", "com", "2024-01-01", "2024-01-02", True)], "name string, tld string, first_seen string, last_seen string, is_active boolean")
    state = state.withColumn("first_seen", F.to_date("first_seen")).withColumn("last_seen", F.to_date("last_seen"))
    got = {r.name: (str(r.first_seen), str(r.last_seen), r.is_active) for r in O.lifecycle(today, state, d("2024-01-09")).collect()}
    assert got == {"a.com": ("2024-01-01", "2024-01-09", True), "b.com": ("2024-01-01", "2024-01-02", False), "c.com": ("2024-01-09", "2024-01-09", True)}


def test_upsert_guards_settled_matches(spark):
    schema = "name string, status string, score int, bucket string, first string"
    old = spark.createDataFrame([("a", "dismissed", 1, "x", "d1"), ("b", "new", 1, "x", "d1")], schema)
    new = spark.createDataFrame([("a", "new", 2, "y", "d2"), ("b", "new", 2, "y", "d2"), ("c", "new", 2, "y", "d2")], schema)
    got = {r.name: tuple(r)[1:] for r in O.upsert_matches(old, new, ["name"], ["status", "first"], ["bucket"]).collect()}
    assert got == {"a": ("dismissed", 2, "x", "d1"), "b": ("new", 2, "y", "d1"), "c": ("new", 2, "y", "d2")}


def test_scan_finds_typo_variants(spark):
    from zonewright.operators import candidates as C
    from zonewright.plans import names as N
    from zonewright.plans import views as V

    names = spark.createDataFrame([("thstin.com", "com", "thstin", 20240120), ("qqqqqq.com", "com", "qqqqqq", 20240120)], "name string, tld string, label string, added_day int")
    variants = C.typo_variants(V.brand(spark), "brand_label", N.KEYS).withColumnRenamed("brand_label", "seed_value")
    without = C.brand_scan(names, N._seeds(spark, ""), N.as_of())
    found = C.brand_scan(names, N._seeds(spark, ""), N.as_of(), variants=variants)
    assert without.count() == 0 and [(r.name, r.seed_value) for r in found.collect()] == [("thstin.com", "thatin")]


def test_rescore_sums_all_rule_sets(spark, sf_dir):
    from zonewright.plans import catalogue

    codes = {c for r in catalogue.queries()["JOB09_enrichment_all_rules"](spark, sf_dir).collect() for c in r.codes.split(",")}
    one_of_each = {"recent_registration", "no_active_dns", "https_live", "parked_page", "mail_spoofing_high", "risky_hosting_country", "certificate_revoked", "safe_browsing_listed", "urlhaus_listed", "website_clone"}
    assert one_of_each <= codes


def test_many_seeds_are_looked_up(spark):
    """More seeds than are tried on every name, some of one or two letters, against contains."""
    from zonewright.operators import candidates as C

    labels = ["alphabet", "betamax", "ab", "a", "gammaray", "zeta", "lphx"]
    names = spark.createDataFrame([(f"{x}.com", "com", x, 1) for x in labels], "name string, tld string, label string, added_day int")
    seeds = ["alp", "beta", "bet", "phab", "zeta", "ab", "a", "max", "gammarayx", ""] + [f"none{i}" for i in range(60)]
    got = {(r.label, r.seed_value) for r in C.substring_candidates(names, spark.createDataFrame([(s,) for s in seeds], "seed_value string")).collect()}
    assert got == {(x, s) for x in labels for s in seeds if s and s in x}


def test_newest_before_against_pairs(spark):
    import random

    from zonewright.operators import reports as R

    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randint(0, 12), rng.choice(["ok", "bad"])) for i in range(150)]
    d = spark.createDataFrame(rows, "id long, k string, m int, status string").selectExpr("id", "k", "m", "status", "timestamp_seconds(m * 60) AS at")
    got = {r.id: r.cached for r in R.newest_before(d, ["k"], "at", "id", d.status == "ok", "4 MINUTES").collect()}
    for i, k, m, _ in rows:
        near = [(n, j) for j, x, n, s in rows if x == k and s == "ok" and j != i and m - 4 < n <= m]
        assert got[i] == (max(near)[1] if near else None)
