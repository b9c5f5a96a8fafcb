"""Seeds of brand profiles: repeated brands and ties against plain loops, and what is dealt out before it grows."""

import contextlib
import io

from zonewright.operators import profiles as P


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def dealt_first(df):
    """Nothing is made of a brand before brands are dealt out, and nothing that was made is moved again."""
    plan = plan_of(df)
    return plan.count("Exchange hashpartitioning(brand_id") == plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def text(x):
    return "".join(c for c in x.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def test_combo_seeds_by_brand(spark):
    brands = [(1, ["pay", "ay"], ["pay", "x"]), (1, ["pay", "other"], ["pay"]), (2, ["a"], None), (3, None, []), (4, ["b", None], ["w" * i for i in range(1, 600)]), (None, ["c"], [])]
    df = spark.createDataFrame(brands, "brand_id int, cores array<string>, keywords array<string>")
    made = {}
    for brand, cores, keywords in brands:
        if cores is None or keywords is None:
            continue
        words = list(dict.fromkeys([*P.S.RISK_WORDS, *keywords, *P.SUFFIXES]))
        for i, core in enumerate(cores):
            if core is not None:
                rows = [(text(v), k, i * 1000 + 2 * j + n) for j, w in enumerate(words) for n, (v, k) in enumerate(((core + w, "combo_brand_keyword"), (w + core, "combo_keyword_brand")))]
                rows += [(text(w + core), "combo_keyword_brand", (i + 1000) * 1000 + j) for j, w in enumerate(P.PREFIXES)]
                for v, k, at in rows:
                    if len(v) >= 3:
                        made[brand, v, k] = min(at, made.get((brand, v, k), at))
    for most in (1, 7, 120, 5000):
        want = set()
        for brand in {b for b, _, _ in made}:
            ranked = sorted((at, v, k) for (b, v, k), at in made.items() if b == brand)[:most]
            want |= {(brand, v, k, P.WEIGHTS[k], r) for r, (_, v, k) in enumerate(ranked, 1)}
        got = [tuple(r) for r in P.combo_seeds(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert dealt_first(P.combo_seeds(df))


def test_model_seeds_by_brand(spark):
    reply = '{"seeds": [{"seed_value": "Shop", "seed_type": "llm_semantic"}, {"seed_value": "shop!", "seed_type": "odd"}, {"seed_value": null}, {"seed_value": "xy"}, {"seed_value": "buy me", "seed_type": "odd"}]}'
    df = spark.createDataFrame([(1, reply), (1, '{"seeds": [{"seed_value": "second", "seed_type": "llm_combo"}]}'), (2, "{}"), (3, None)], "brand_id int, reply string")
    got = sorted(tuple(r) for r in P.model_seeds(df, 3).collect())
    assert got == [(1, "buyme", "llm_combo", 0.72, 3), (1, "second", "llm_combo", 0.72, 1), (1, "shop", "llm_semantic", 0.58, 2)]
    assert dealt_first(P.model_seeds(df, 3))


def test_alias_inputs_by_brand(spark):
    rows = [(1, " Pay ", ["pay", "PAY", None, "!"], None, ["x", "X"]), (1, None, ["y", " pay"], ["pay"], []), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "brand_id int, primary string, aliases array<string>, phrases array<string>, keywords array<string>")
    got = sorted(tuple(r) for r in P.alias_inputs(df).collect())
    assert got == [(1, "Pay", "pay", "brand_primary"), (1, "pay", "pay", "brand_alias"), (1, "pay", "pay", "brand_phrase"), (1, "x", "x", "support_keyword"), (1, "y", "y", "brand_alias")]
    assert dealt_first(P.alias_inputs(df))


def test_profile_seeds_are_dealt_before_repeats_are_sought(spark):
    domains = spark.createDataFrame([(1, "www.pay.com"), (1, "WWW.Pay.com."), (1, "pay.com.br"), (2, None)], "brand_id int, domain string")
    aliases = spark.createDataFrame([(1, "Pay", "pay", "brand_primary"), (1, "pay", "pay", "brand_alias")], "brand_id int, value string, normalized string, type string")
    seeds = P.profile_seeds(domains, aliases)
    plan = plan_of(seeds)
    assert "REPARTITION_BY_NUM" in plan and plan.index("Generate") < plan.index("REPARTITION_BY_NUM")
    got = sorted((r.seed_type, r.seed_value, r.channel_scope) for r in seeds.collect())
    assert got == [("brand_alias", "pay", "associated_brand"), ("brand_primary", "pay", "both"), ("domain_label", "pay", "registrable_domain"), ("hostname_stem", "pay.com", "certificate_hostname"), ("official_domain", "pay.com.br", "certificate_hostname"), ("official_domain", "www.pay.com", "certificate_hostname")]
    assert seeds.count() == 6
