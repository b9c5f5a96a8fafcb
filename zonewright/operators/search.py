"""The search for names like one domain: lexical and encoded candidates, merged, scored on what a reader sees, and paged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import idna as I
from ..functions import labels as L
from ..functions import scores as S
from . import candidates as C
from . import triage as T

# Least number of candidates that each of the two scans may bring, and the source that holds names.
SCANNED, SOURCE = 600, "czds"


@dataclass(frozen=True)
class Search:
    """What is looked for. algorithms: hybrid, fuzzy and typo; an empty tld_allowlist or sources means any."""

    domain: str
    algorithms: tuple[str, ...] = ("hybrid",)
    min_score: float = 0.3
    max_results: int = 50
    offset: int = 0
    include_subdomains: bool = False
    exclude_official: bool = False
    tld_allowlist: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()

    @property
    def fuzzy(self) -> bool:
        return bool({"fuzzy", "hybrid"} & set(self.algorithms))

    @property
    def typo(self) -> bool:
        return bool({"typo", "hybrid"} & set(self.algorithms))

    @property
    def scanned(self) -> int:
        """How many candidates each scan brings, at most."""
        return max(self.max_results + self.offset + 1, SCANNED)


def registered(spark: SparkSession, domain: str) -> tuple[str, str]:
    """The registrable domain of what was asked for, and its label."""
    name = L.normalize_domain(F.lit(domain))
    r = spark.range(1).select(L.registrable_domain(name).alias("name"), L.registrable_label(name).alias("label")).first()
    if not r.name or not r.label:
        raise ValueError(f"not a domain: {domain}")
    return r.name, r.label


def _typos(spark: SparkSession, label: str, keys: dict[str, str]) -> DataFrame:
    """The label's typos, in letters beyond ASCII encoded: a few hundred rows."""
    one = spark.createDataFrame([(0, label)], "brand_id int, brand_label string")
    plain = C.typo_variants(one, "brand_label", keys).select(F.col("variant").alias("label"))
    return plain.unionByName(C.homograph_seeds(one, I.LOOKALIKES, 10**6).select(F.col("seed_value").alias("label"))).distinct()


def search_candidates(names: DataFrame, asked: Search, label: str, keys: dict[str, str]) -> DataFrame:
    """(name, tld, label, added_day, sim): the best of both scans, one row for each name.

    Endings and sub-domains are filtered in the scan. The lexical scan takes names that share enough trigrams with the label or hold it,
    and its typos; the other one the newest encoded names. Either keeps a bounded number by a distributed top-k.
    """
    spark = names.sparkSession
    rows = names.select("name", "tld", "label", "added_day")
    if asked.tld_allowlist:
        rows = rows.filter(F.col("tld").isin(*asked.tld_allowlist))
    if not asked.include_subdomains:
        rows = C.without_subdomains(rows)
    sim = L.trigram_similarity_to(F.col("label"), label)
    near = F.lit(False)
    lexical = rows
    if asked.typo:
        lexical = lexical.join(F.broadcast(_typos(spark, label, keys).withColumn("is_typo", F.lit(True))), "label", "left")
        near = F.coalesce("is_typo", F.lit(False))
    lexical = lexical.withColumn("sim", sim)
    if asked.fuzzy:
        near = near | (F.col("sim") >= (0.5 if len(label) <= 5 else 0.3)) | F.contains("label", F.lit(label))
    found = lexical.filter(near).orderBy(F.desc("sim"), F.desc_nulls_first("added_day"), "name").limit(asked.scanned)
    encoded = C.encoded_names(rows).orderBy(F.desc_nulls_last("added_day"), "name").limit(asked.scanned).withColumn("sim", sim)
    kept = [F.col(c) for c in ("name", "tld", "label", "added_day", "sim")]
    both = found.select(*kept, F.lit(0).alias("scan")).unionByName(encoded.select(*kept, F.lit(1).alias("scan")))
    first = Window.partitionBy("name").orderBy(F.desc("sim"), F.desc(F.coalesce("added_day", F.lit(0))), "scan")
    return both.withColumn("r", F.row_number().over(first)).filter("r = 1").select(*kept)


def search_score(algorithms: tuple[str, ...], whole: Column, fuzzy: Column, typo: Column) -> Column:
    if "hybrid" in algorithms or not {"fuzzy", "typo"} & set(algorithms):
        return whole
    return F.greatest(fuzzy, typo) if {"fuzzy", "typo"} <= set(algorithms) else fuzzy if "fuzzy" in algorithms else typo


RESULT = "domain string, tld string, source string, status string, score double, fuzzy double, typo double, vector double, reasons array<string>, observed_at date, is_official boolean, ownership string, disposition string"


def search_results(names: DataFrame, asked: Search, keys: dict[str, str]) -> DataFrame:
    """Every name found, with its scores: at most twice as many rows as a scan brings.

    Labels are scored as they are read: encoded ones are decoded, and look-alikes beyond ASCII folded, on their branch alone.
    """
    spark = names.sparkSession
    if tuple(asked.algorithms) == ("vector",):
        raise ValueError("vectors aren't searched")
    official, label = registered(spark, asked.domain)
    if asked.sources and SOURCE not in asked.sources:
        return spark.createDataFrame([], RESULT)
    rows = search_candidates(names, asked, label, keys).withColumn("is_official", F.col("name") == official)
    if asked.exclude_official:
        rows = rows.filter("NOT is_official")
    # Computed before the scores use them, which is often.
    rows = rows.withColumn("shown", I.idna_decode(F.col("label"))).withColumn("plain", I.homograph_normalize(F.col("shown")))
    s = S.signals(F.col("shown"), F.lit(label), F.array().cast("array<string>"), F.col("sim"), F.col("plain"))
    rows = rows.select("*", s.trigram.alias("t"), s.edit.alias("e"), s.brand.alias("b"), s.keyword.alias("k"), s.homograph.alias("h"), s.exact.alias("x"))
    s = S.Signals(*[F.col(c) for c in "tebkhx"])
    # Single scores are rounded before they are compared, the whole one once.
    fuzzy, typo = F.greatest(L.round4(F.col("t")), L.round4(F.col("b"))), F.greatest(L.round4(F.col("e")), L.round4(F.col("h")))
    rows = rows.withColumns({"score": search_score(asked.algorithms, L.round4(S.composite(s)), fuzzy, typo), "fuzzy": fuzzy, "typo": typo, "reasons": S.reasons(s)})
    rows = rows.filter(F.col("score") >= asked.min_score)
    owner = F.when(F.col("is_official"), "official").otherwise("third_party_unknown")
    return rows.select(
        F.col("name").alias("domain"), "tld", F.lit(SOURCE).alias("source"), F.lit("active").alias("status"), "score", "fuzzy", "typo", F.lit(0.0).alias("vector"), "reasons",
        L.int_date(F.col("added_day")).alias("observed_at"), "is_official", owner.alias("ownership"), T.search_disposition(F.col("is_official"), F.col("reasons"), F.col("tld"), F.col("score")).alias("disposition"),
    )


def search_page(names: DataFrame, asked: Search, keys: dict[str, str]) -> DataFrame:
    """One page of the results, best first, with how many there are and whether more follow; computed once."""
    order = [F.desc("score"), F.desc_nulls_last("observed_at"), F.desc("domain")]
    # Results are bounded by the scans, so one task can number them.
    every = Window.partitionBy(F.lit(0))
    rows = search_results(names, asked, keys).withColumn("place", F.row_number().over(every.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(every))
    page = rows.filter((F.col("place") > asked.offset) & (F.col("place") <= asked.offset + asked.max_results))
    return page.withColumn("has_more", F.col("total") > asked.offset + asked.max_results).orderBy("place")
