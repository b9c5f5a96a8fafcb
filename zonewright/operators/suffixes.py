"""Registrable domains by a table of public-suffix rules, with wildcards and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from . import candidates as C


def rule_table(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """(ending, rules): the rules of each last label, as (suffix, labels, kind); kind: exact, wildcard (*.x) or exception (!x).

    Blank lines and comments (//) drop out, as do white space and outer dots; a rule that is there twice counts once.
    """
    r = F.lower(F.get(F.split(F.trim(rule), r"\s+"), 0))
    rows = rules.select(r.alias("r")).filter((F.col("r") != "") & ~F.startswith("r", F.lit("//"))).distinct()
    kind = F.when(F.startswith("r", F.lit("!")), "exception").when(F.startswith("r", F.lit("*.")), "wildcard").otherwise("exact")
    rows = rows.select(kind.alias("kind"), F.btrim(F.regexp_replace("r", r"^(!|\*\.)", ""), F.lit(".")).alias("suffix")).filter("suffix <> ''")
    rows = rows.withColumn("labels", F.size(F.split("suffix", r"\.")))
    return rows.groupBy(F.substring_index("suffix", ".", -1).alias("ending")).agg(F.collect_list(F.struct("suffix", "labels", "kind")).alias("rules"))


def _suffix_labels(name: Column, rules: Column) -> Column:
    """How many labels the public suffix has: an exception's but the first, else the most that a rule matches; null where none does."""
    ends = lambda r: (name == r["suffix"]) | F.endswith(name, F.concat(F.lit("."), r["suffix"]))
    count = F.size(F.split(name, r"\."))
    fits = F.filter(rules, lambda r: ends(r) & ((r["kind"] != "wildcard") | (count > r["labels"])))
    reach = lambda r: F.when(r["kind"] == "exception", r["labels"] + 999).when(r["kind"] == "wildcard", r["labels"] + 1).otherwise(r["labels"])
    most = F.array_max(F.transform(fits, reach))
    return F.when(most >= 1000, most - 1000).otherwise(most)


def registrable_parts(names: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """names with registrable_domain, registrable_label and public_suffix.

    The longest rule wins, exceptions first. Where none matches, or nothing is left of the suffix, the second-level rule of the library
    stands, as it does for an empty table. Rules are grouped by their last label and broadcast after a check of their bytes.
    """
    n = names.withColumn("__ending", F.substring_index(name, ".", -1))
    j = n.join(C.few(rule_table(rules).withColumnRenamed("ending", "__ending")), "__ending", "left")
    host = F.col(name)
    j = j.withColumn("__k", _suffix_labels(host, F.col("rules"))).withColumn("__n", F.size(F.split(host, r"\.")))
    ruled = F.col("__k").isNotNull() & (F.col("__n") > F.col("__k")) & (F.col("__k") > 0)
    part = lambda extra: F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.col("__n") - F.col("__k") - extra + 1, F.lit(1)), F.greatest(F.col("__k") + extra, F.lit(0))), ".")
    domain = F.when(ruled, part(1)).otherwise(L.registrable_domain(host))
    suffix = F.when(ruled, part(0)).otherwise(L.public_suffix(host))
    return j.withColumns({"registrable_domain": domain, "registrable_label": F.substring_index(domain, ".", 1), "public_suffix": suffix}).drop("__ending", "__k", "__n", "rules")
