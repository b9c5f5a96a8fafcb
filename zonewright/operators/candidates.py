"""Finding and scoring names that imitate brands: candidate joins, scoring and the whole scan.

Names are never shuffled by ending, which is skewed; brands and seeds are few and broadcast after a check
of their number. Labels with a dot are sub-domains and never scanned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import idna as I
from ..functions import labels as L
from ..functions import scores as S
from ..sources import zones as Z

#: Seeds are broadcast up to this many rows and bytes (as JSON); beyond it the joins shuffle.
FEW, FEW_BYTES = 100_000, 32 << 20
#: Counts of trigrams are kept in so many slots.
SLOTS = 1 << 14
#: How many ways the names of one ending and length are dealt.
DEALT = 16
#: Seeds that are tried on every name rather than looked up.
TRIED = 32


def are_few(df: DataFrame) -> bool:
    size = df.limit(FEW + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return size.n <= FEW and size.bytes <= FEW_BYTES


def few(df: DataFrame) -> DataFrame:
    """A broadcast hint where the counted rows and their bytes are few."""
    return F.broadcast(df) if are_few(df) else df


def without_subdomains(names: DataFrame) -> DataFrame:
    return names.filter(~F.col("label").contains("."))


def exact_candidates(names: DataFrame, seeds: DataFrame) -> DataFrame:
    """Names whose label is a seed: an equi-join, whatever the number of seeds."""
    return names.join(few(seeds), names["label"] == seeds["seed_value"])


def trigram_candidates(names: DataFrame, seeds: DataFrame, threshold: Column | None = None) -> DataFrame:
    """Pairs (name, seed) of trigram similarity at the threshold or above, with sim.

    A prefix filter: trigrams are ordered by how many seeds have them, rare ones first. Sets of n trigrams that are t alike
    share t * n of them at least, so one that both have is among the first n - t * n + 1 of either. A name's trigrams that no seed
    has can't be shared: they are dropped first, with names that keep too few, and only the prefix of the rest is exploded.
    Pairs whose sizes, or what is left after the trigram's position, rule them out go before the shuffle that takes each pair once;
    those left are compared whole.
    """
    least = threshold if threshold is not None else L.trigram_threshold(F.col("seed_value"))
    s = seeds.select("seed_value").distinct().select("seed_value", least.alias("t"), L.trigrams(F.col("seed_value")).alias("gs"))
    # One number for each of SLOTS hashes of trigrams: bounded, whatever the seeds.
    counts = s.select("t", F.explode("gs").alias("g")).groupBy(_slot(F.col("g")).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t")).collect()
    if not counts:
        return names.select("name", "tld", "label", "added_day").join(s.select("seed_value"), F.lit(False)).withColumn("sim", F.lit(0.0))
    rarity = ["-1"] * SLOTS
    for r in counts:
        rarity[r.slot] = str(min(r.n, 2**31 - 1))
    rare = F.split(F.lit(",".join(rarity)), ",").cast("array<int>")
    lowest = F.lit(min(r.t for r in counts))

    known = lambda gs: F.filter(gs, lambda g: F.get(rare, _slot(g)) >= 0)
    need = lambda size, t: F.ceil(size * t - 1e-9)

    def prefixes(size: Column, t: Column, held: Column) -> Column:
        """(size, known, g, place) of the first trigrams of a set; known: how many of them a seed may have."""
        ranked = F.array_sort(F.transform(held, lambda g: F.struct(F.get(rare, _slot(g)).alias("n"), g.alias("g"))))
        first = F.slice(ranked, 1, (F.size(held) - need(size, t) + 1).cast("int"))
        return F.transform(first, lambda x, i: F.struct(size.cast("int").alias("size"), F.size(held).alias("known"), x["g"].alias("g"), (i + 1).alias("place")))

    # Few names keep enough trigrams, and only theirs are put in order.
    none = F.array().cast("array<struct<size:int,known:int,g:string,place:int>>")
    kept = lambda size, held: F.when(F.size(held) >= F.greatest(need(size, lowest), F.lit(1)), prefixes(size, lowest, held)).otherwise(none)
    of_name = L.once(L.trigrams(F.col("label")), lambda gs: L.once(known(gs), lambda held: kept(F.size(gs), held)))
    n = names.select("name", "tld", "label", "added_day", F.inline(of_name)).toDF("name", "tld", "label", "added_day", "n1", "k1", "g", "p1")
    s = s.select("seed_value", "t", F.inline(prefixes(F.size("gs"), F.col("t"), F.col("gs")))).toDF("seed_value", "t", "n2", "k2", "g", "p2")
    pairs = _by_trigram(n, s)
    fits = (F.least("n1", "n2") >= F.col("t") * F.greatest("n1", "n2")) & ((1 + F.least(F.col("k1") - F.col("p1"), F.col("k2") - F.col("p2"))) * (1 + F.col("t")) >= F.col("t") * (F.col("n1") + F.col("n2")) - 1e-9)
    pairs = pairs.filter(fits).select("name", "tld", "label", "added_day", "seed_value", "t").distinct()
    pairs = pairs.withColumn("sim", L.trigram_similarity(F.col("label"), F.col("seed_value")))
    return pairs.filter("sim >= t").select("name", "tld", "label", "added_day", "seed_value", "sim")


def _slot(g: Column) -> Column:
    return F.pmod(F.xxhash64(g), F.lit(SLOTS)).cast("int")


def _by_trigram(n: DataFrame, s: DataFrame) -> DataFrame:
    """Prefixes joined by trigram. Where the seeds are too many to broadcast, names of one trigram are dealt DEALT ways, so that a frequent
    one isn't one task's."""
    if are_few(s):
        return n.join(F.broadcast(s), "g")
    ways = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))
    return n.withColumn("__deal", F.pmod(F.xxhash64("name"), F.lit(DEALT)).cast("int")).join(s.withColumn("__deal", ways), ["g", "__deal"]).drop("__deal")


def substring_candidates(names: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs (name, seed) where the label holds the seed, with sim.

    A handful of seeds is tried on every name. More are found by an anchor: of a seed's three-letter windows (a shorter seed is its own) the one
    that the fewest seeds have, so that seeds with a common beginning or end don't meet under one key. Of a label's windows
    only those that may be an anchor are exploded. An empty seed is in no label.
    """
    n, s = names.select("name", "tld", "label", "added_day"), seeds.select("seed_value").distinct().filter(F.length("seed_value") > 0)
    holds = F.contains("label", "seed_value")
    if s.limit(TRIED + 1).count() <= TRIED:
        found = n.join(F.broadcast(s), holds)
    else:
        spread = s.select("seed_value", F.explode(F.array_distinct(_windows(F.col("seed_value"), F.least(F.length("seed_value"), F.lit(3))))).alias("g"))
        held = spread.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        anchors = Z.stored(spread.join(held, "g").groupBy("seed_value").agg(F.min_by("g", F.struct("n", "g")).alias("g")), "anchors")
        # One sign for each of SLOTS hashes of anchors.
        taken = {r.slot for r in anchors.select(_slot(F.col("g")).alias("slot")).distinct().collect()}
        anchor = F.lit("".join("1" if i in taken else "0" for i in range(SLOTS)))
        windows = F.concat(*[_windows(F.col("label"), F.lit(k)) for k in (1, 2, 3)])
        windows = F.filter(F.array_distinct(windows), lambda g: F.substr(anchor, _slot(g) + 1, F.lit(1)) == "1")
        found = _by_trigram(n.select("*", F.explode(windows).alias("g")), anchors).filter(holds).drop("g")
    return found.withColumn("sim", L.trigram_similarity(F.col("label"), F.col("seed_value")))


def _windows(x: Column, size: Column) -> Column:
    """All parts of so many letters; none of a shorter text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(x) - size + 1, F.lit(1)))
    return F.filter(F.transform(at, lambda i: F.substr(x, i, size)), lambda g: F.length(g) == size)


# Most encoded names of an ending that a brand is held against, and for any other ending.
ENCODED_LIMITS, OTHER_ENCODED_LIMIT = {"com": 2000, "net": 1500, "org": 1500}, 1200


def encoded_names(names: DataFrame) -> DataFrame:
    """Names whose label is punycode; the prefix is pushed down to the scan."""
    return names.filter(F.startswith("label", F.lit("xn--")))


def encoded_candidates(names: DataFrame, brands: DataFrame) -> DataFrame:
    """For each brand and ending the encoded names of least edit distance, newest first, up to the ending's limit."""
    return nearest_by_edits(encoded_names(names), brands, lambda tld: S.choose(ENCODED_LIMITS, tld, OTHER_ENCODED_LIMIT))


def nearest_by_edits(names: DataFrame, brands: DataFrame, limit: Callable[[Column], Column]) -> DataFrame:
    """For each brand and ending the names whose labels are nearest to the brand's by edit distance, then the newest, up to the ending's limit.

    Exact, and without a pair of everything: two texts are at least as far apart as their lengths, and at most as the longer
    is long. So counts of names by ending and length tell a reach within which enough are found for sure. Names of lengths
    within reach are joined by ending and length (a hot one dealt DEALT ways) and held against the brand by a distance that gives up
    beyond the reach: first they are only counted, by distance and day, which tells where the list ends; then those up to
    there are joined again and put in order, each deal by itself before all together.

    names: name, tld, label, added_day and more; brands: brand_id, brand_label and more. Names without a label or brands without one find nothing.
    Rows that agree in distance, day and name are taken in any order.
    """
    held = names.filter(F.col("label").isNotNull()).withColumn("__n", F.length("label")).withColumn("__deal", F.pmod(F.xxhash64("name"), F.lit(DEALT)).cast("int"))
    held = Z.stored(held, "names-by-length")
    b = brands.filter(F.col("brand_label").isNotNull()).withColumn("__b", F.length("brand_label"))
    # No more than one row for each ending and length, one number for each length of a brand.
    lengths = held.groupBy("tld", "__n").agg(F.count(F.lit(1)).alias("__c"))
    sizes = [r[0] for r in b.select("__b").distinct().collect()]
    if not sizes:
        return held.withColumn("distance", F.lit(0)).join(b, F.lit(False)).drop("__n", "__deal", "__b")
    far = lengths.withColumn("__b", F.explode(F.array(*map(F.lit, sizes)))).withColumn("__far", F.greatest("__n", "__b"))
    far = far.withColumn("__sure", F.sum("__c").over(Window.partitionBy("tld", "__b").orderBy("__far")))
    reach = far.groupBy("tld", "__b").agg(F.coalesce(F.min(F.when(F.col("__sure") >= limit(F.col("tld")), F.col("__far"))), F.max("__far")).alias("__reach"))
    todo = b.join(F.broadcast(reach), "__b")

    def within(asked: DataFrame) -> DataFrame:
        """Names no further than __reach from the brands that ask."""
        asked = asked.withColumn("__n", F.explode(F.sequence(F.greatest(F.col("__b") - F.col("__reach"), F.lit(0)), F.col("__b") + F.col("__reach"))))
        asked = asked.join(F.broadcast(lengths.select("tld", "__n")), ["tld", "__n"]).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        return held.join(asked, ["tld", "__n", "__deal"]).withColumn("distance", F.expr("levenshtein(label, brand_label, __reach)")).filter("distance >= 0")

    counts = within(todo).groupBy("brand_id", "tld", "distance", "added_day").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy("brand_id", "tld").orderBy("distance", F.desc("added_day")))
    kept = counts.withColumn("__upto", upto).filter(F.col("__upto") - F.col("__c") < limit(F.col("tld")))
    # The last distance and day that are needed: one row for each brand and ending.
    last = kept.groupBy(F.col("brand_id").alias("__i"), F.col("tld").alias("__t")).agg(F.max_by(F.struct("distance", "added_day"), "__upto").alias("__last"))
    last = Z.stored(last, "nearest-last")
    asked = todo.join(last, F.col("brand_id").eqNullSafe(F.col("__i")) & (F.col("tld") == F.col("__t"))).drop("__i", "__t").withColumn("__reach", F.col("__last.distance"))
    day = F.col("__last.added_day")
    near = within(asked).filter((F.col("distance") < F.col("__reach")) | day.isNull() | (F.col("added_day") >= day)).drop("__last", "__reach")
    for keys in (["brand_id", "tld", "__deal"], ["brand_id", "tld"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", F.desc("added_day"), "name"))
        near = near.withColumn("__r", place).filter(F.col("__r") <= limit(F.col("tld")))
    columns = [*names.columns, *[c for c in brands.columns if c not in names.columns], "distance"]
    return Z.stored(near.select(*columns), "nearest")


def seed_limit(seeds: int) -> int:
    """How many names of an ending each of so many seeds may bring."""
    return max(250, min(1500, 5000 // max(1, seeds)))


def best_by_name(candidates: DataFrame) -> DataFrame:
    """For each name and seed the row of highest similarity, then latest day."""
    w = Window.partitionBy("name", "seed_value").orderBy(F.desc("sim"), F.desc("added_day"))
    return candidates.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def per_seed_limit(candidates: DataFrame, limit: int | None) -> DataFrame:
    """The best `limit` names of each seed and ending; None keeps all."""
    if limit is None:
        return candidates
    w = Window.partitionBy("seed_value", "tld").orderBy(F.desc("sim"), "name")
    return candidates.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")


def typo_variants(brands: DataFrame, label: str, adjacent: dict[str, str]) -> DataFrame:
    """(label, variant, kind): omission, duplication, swap, neighbouring key and look-alike of every letter."""
    x, n = F.col(label), F.length(label)
    at = brands.select(label, F.explode(F.sequence(F.lit(1), n)).alias("i"))
    head, tail = F.substr(x, F.lit(1), F.col("i") - 1), F.substr(x, F.col("i") + 1)
    c, after = F.substr(x, F.col("i"), F.lit(1)), F.substr(x, F.col("i") + 1, F.lit(1))
    keys = F.create_map(*[F.lit(v) for kv in adjacent.items() for v in kv])
    looks = {}
    for look, letter in zip(*L.LOOKALIKES, strict=True):
        looks[letter] = looks.get(letter, "") + look
    similar = F.create_map(*[F.lit(v) for kv in looks.items() for v in kv])
    letters = lambda m: F.filter(F.split(F.coalesce(F.try_element_at(m, c), F.lit("")), ""), lambda v: v != "")
    put = lambda kind, value: F.struct(value.alias("variant"), F.lit(kind).alias("kind"))
    made = F.concat(
        F.array(put("omission", F.concat(head, tail)), put("duplication", F.concat(head, c, c, tail))),
        F.when(F.col("i") < n, F.array(put("swap", F.concat(head, after, c, F.substr(x, F.col("i") + 2))))).otherwise(F.array().cast("array<struct<variant:string,kind:string>>")),
        F.transform(letters(keys), lambda k: put("key", F.concat(head, k, tail))),
        F.transform(letters(similar), lambda k: put("look", F.concat(head, k, tail))),
    )
    return at.select(label, F.inline(made)).filter((F.col("variant") != x) & (F.length("variant") > 0)).distinct()


def typo_seeds(brands: DataFrame, adjacent: dict[str, str], most: int = 50) -> DataFrame:
    """(brand_id, seed_value): the `most` shortest typo variants of each brand's label, of three letters or more."""
    v = typo_variants(brands, "brand_label", adjacent).filter(F.length("variant") >= 3).select("brand_label", "variant").distinct()
    place = F.row_number().over(Window.partitionBy("brand_label").orderBy(F.length("variant"), "variant"))
    v = v.withColumn("r", place).filter(F.col("r") <= most).select(F.col("brand_label").alias("__b"), F.col("variant").alias("seed_value"))
    return brands.select("brand_id", "brand_label").join(v, F.col("brand_label") == F.col("__b")).select("brand_id", "seed_value")


def homograph_seeds(brands: DataFrame, lookalikes: dict[str, str], most: int = 30) -> DataFrame:
    """(brand_id, seed_value): the label with one letter replaced by a look-alike beyond ASCII, encoded.

    Letters are taken from the left until `most` seeds are made; those of the last letter all stay.
    """
    looks: dict[str, list[str]] = {}
    for look, letter in lookalikes.items():
        looks.setdefault(letter, []).append(look)
    similar = F.create_map(*[x for letter, v in looks.items() for x in (F.lit(letter), F.array(*map(F.lit, v)))])
    b = F.col("brand_label")
    at = brands.filter(F.length(b) > 0).select("brand_id", "brand_label", F.explode(F.sequence(F.lit(1), F.length(b))).alias("i"))
    at = at.withColumn("looks", F.try_element_at(similar, F.substr(b, F.col("i"), F.lit(1)))).filter(F.col("looks").isNotNull())
    before = F.sum(F.size("looks")).over(Window.partitionBy("brand_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    made = at.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most).select("brand_id", F.transform("looks", lambda x: F.concat(F.substr(b, F.lit(1), F.col("i") - 1), x, F.substr(b, F.col("i") + 1))).alias("v"))
    return made.select("brand_id", F.explode("v").alias("v")).select("brand_id", I.idna_encode(F.col("v")).alias("seed_value")).filter(F.startswith("seed_value", F.lit("xn--"))).distinct()


def typo_candidates(names: DataFrame, variants: DataFrame) -> DataFrame:
    """Pairs (name, seed) where the label is a variant of the seed, with sim; variants: seed_value, variant."""
    v = variants.select("seed_value", "variant").distinct()
    found = names.select("name", "tld", "label", "added_day").join(few(v), F.col("label") == F.col("variant"))
    return found.withColumn("sim", L.trigram_similarity(F.col("label"), F.col("seed_value"))).drop("variant")


def scored(candidates: DataFrame, seeds: DataFrame, as_of: Column, shown: Column | None = None, plain: Callable[[Column], Column] = L.unmasked) -> DataFrame:
    """Candidates (name, tld, label, added_day, seed_value, sim) with every score, rule and triage column.

    shown: the label as it is read, where that differs; plain: how look-alikes are replaced.

    seeds: seed_value, seed_type, channel_scope, base_weight, brand_id, brand_label, keywords, noise_mode.
    """
    c = candidates.join(few(seeds), "seed_value")
    if shown is not None:
        # Computed before the scores use them, which is often.
        c = c.withColumn("__shown", shown).withColumn("__plain", plain(F.col("__shown")))
        s = S.signals(F.col("__shown"), F.col("seed_value"), F.col("keywords"), F.col("sim"), F.col("__plain"))
    else:
        s = S.signals(F.col("label"), F.col("seed_value"), F.col("keywords"), F.col("sim"))
    # The signals become columns before rules use them, which is often.
    c = c.select("*", s.trigram.alias("__t"), s.edit.alias("score_levenshtein"), s.brand.alias("score_brand_hit"), s.keyword.alias("score_keyword"), s.homograph.alias("score_homograph"), s.exact.alias("__x"))
    s = S.Signals(*[F.col(x) for x in ("__t", "score_levenshtein", "score_brand_hit", "score_keyword", "score_homograph", "__x")])
    c = c.select("*", L.round4(S.composite(s)).alias("base"), S.reasons(s).alias("reasons")).drop("__t", "__x")
    c = c.withColumn("score_final", L.round4(S.seeded_score(F.col("base"), F.col("base_weight"), F.col("channel_scope"))))
    c = c.withColumn("risk_level", S.seeded_risk(F.col("score_final"), F.col("reasons"), F.col("channel_scope")))
    c = c.withColumn("matched_channel", F.when(F.col("seed_type") == "domain_label", "registrable_domain").otherwise("associated_brand"))
    c = c.withColumn("matched_rule", S.matched_rule(F.col("reasons"), F.col("matched_channel")))
    score, bucket, why = S.actionability(F.col("name"), F.col("tld"), F.col("score_final"), F.col("risk_level"), F.col("matched_rule"), F.col("seed_type"), F.col("seed_value"), F.col("brand_label"), F.col("matched_channel"), F.col("added_day"), as_of)
    return c.withColumns({"actionability_score": score, "attention_bucket": bucket, "attention_reasons": why}).withColumn("disposition", S.disposition_of(F.col("attention_bucket")))


def best_per_domain(matches: DataFrame) -> DataFrame:
    """For each brand and name the match of highest score, then seed weight, then seed."""
    w = Window.partitionBy("brand_id", "name").orderBy(F.desc("score_final"), F.desc("base_weight"), "seed_type", "seed_value")
    return matches.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def brand_scan(names: DataFrame, seeds: DataFrame, as_of: Column, official: DataFrame | None = None, limit: int | None = None, variants: DataFrame | None = None) -> DataFrame:
    """All brands and endings in one job: fuzzy, typo and exact candidates, scored, above the brand's threshold,
    the best match of each name. variants: seed_value and variant, for the typo ring."""
    plain = without_subdomains(names).select("name", "tld", "label", "added_day")
    if official is not None:
        plain = plain.join(official, "name", "left_anti")
    # Every ring reads the names: they are brought together once.
    plain = Z.stored(plain, "scanned-names")
    fuzzy = seeds.filter(F.col("seed_type").isin("domain_label", "brand_primary", "brand_alias", "brand_phrase")).select("seed_value").distinct()
    others = seeds.filter(~F.col("seed_type").isin("domain_label", "brand_primary", "brand_alias", "brand_phrase")).select("seed_value").distinct()
    ring = trigram_candidates(plain, fuzzy).unionByName(substring_candidates(plain, fuzzy))
    if variants is not None:
        ring = ring.unionByName(typo_candidates(plain, variants.join(few(fuzzy), "seed_value", "left_semi")))
    near = per_seed_limit(best_by_name(ring), limit)
    exact = exact_candidates(plain, others).select("name", "tld", "label", "added_day", "seed_value", F.lit(1.0).alias("sim"))
    found = scored(near.unionByName(exact), seeds, as_of)
    return best_per_domain(found.filter(F.col("score_final") >= S.noise_threshold(F.col("noise_mode"))))


def triage_order(matches: DataFrame) -> list[Column]:
    rank = F.when(F.col("attention_bucket") == "immediate_attention", 0).when(F.col("attention_bucket") == "defensive_gap", 1).otherwise(2)
    return [rank, F.desc("actionability_score"), F.desc("score_final"), F.asc("name")]
